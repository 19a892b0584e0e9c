import datetime as dt

from pyspark.sql import functions as F

from talentweave.functions import dates, text, urls

L = F.lit


def test_text(col):
    assert col(text.squeeze(L(" a \n b "))) == "a b"
    assert col(text.squeeze(L(None).cast("string"))) == ""
    assert col(text.fold(L("Straße"))) == "strasse"
    assert col(text.strip_html(L("<p>a &amp; b<script>var x</script><!-- c --></p><style>s</style> d"))) == "a & b d"
    assert col(text.clean_text(L("<p>window.__x = webpack</p>"))) == ""
    assert col(text.clean_text(L("1 < 2"))) == "1 < 2"
    assert col(text.excerpt(L("one two three"), 8)) == "one two…"
    assert col(text.distinct_sorted(F.array(L("b"), L(" B "), L("a"), L("")))) == ["a", "b"]
    assert col(text.joined_distinct(L("x"), L(" X"), L("y"))) == "x | y"
    assert col(text.section_after(L("About\nRequirements: Python"), "requirements")) == ": Python"
    assert col(text.first_match(L("mail me@x.org now"), text.EMAIL)) == "me@x.org"
    assert abs(col(text.cosine(F.array(L(1.0), L(0.0)), F.array(L(1.0), L(1.0)))) - 0.5**0.5) < 1e-12
    assert col(text.cosine(F.array(L(0.0)), F.array(L(1.0)))) == 0.0


def test_canonical_urls(col):
    u = lambda x: col(urls.canonical_url(L(x)))
    assert u("HTTPS://Example.com//a//b/?utm_source=x&b=2&a=1&ref=z#top") == "https://example.com/a/b?a=1&b=2"
    assert u("https://example.com") == "https://example.com/"
    assert u("https://www.indeed.com/rc/clk?from=web&jk=abc&vjk=zzz") == "https://www.indeed.com/viewjob?jk=abc"
    assert u("not a url") == "not a url"
    assert u(None) == ""


def test_source_and_capture_urls(col):
    assert col(urls.source_url(L("https://www.indeed.com/jobs?q=x&from=s&l=y&__cf_a=1"))) == "https://www.indeed.com/jobs?l=y&q=x"
    assert col(urls.source_type(L("auto"), L("https://jobs.lever.co/acme"))) == "lever"
    assert col(urls.source_type(L(None).cast("string"), L("https://acme.org"))) == "custom_url"
    assert col(urls.capture_url(L(""), L("https://www.indeed.com/jobs"), L("k1"))) == "https://www.indeed.com/viewjob?jk=k1"
    assert col(urls.capture_url(L("/job/2?utm_x=1"), L("https://a.org/list"), L(""))) == "https://a.org/job/2"
    assert col(urls.unwrap_redirect(L("//d.com/l?uddg=https%3A%2F%2Fx.org"))) == "https://x.org"
    assert col(urls.next_page_url(L("https://a.org/l?q=1&page=2"), L(2), L(3))) == "https://a.org/l?page=3&q=1"
    assert col(urls.next_page_url(L("https://a.org/l"), L(3), L(3))) is None


def test_absolute_urls(col):
    a = lambda x: col(urls.absolute_url(L("https://a.org/x/y.html?q#f"), L(x)))
    assert [a("z"), a("../z"), a("/z"), a("//b.org/z"), a("?p=1"), a("http://c.org"), a("")] == [
        "https://a.org/x/z", "https://a.org/z", "https://a.org/z", "https://b.org/z", "https://a.org/x/y.html?p=1",
        "http://c.org", ""
    ]


def test_dates(col):
    assert col(dates.parse_time(L("2024-03-01T10:00:00Z"))) == dt.datetime(2024, 3, 1, 10)
    assert col(dates.parse_time(L("1709287200000"))) == dt.datetime(2024, 3, 1, 10)
    assert col(dates.parse_time(L("0"))) is None and col(dates.parse_time(L("soon"))) is None
    as_of = dt.date(2024, 5, 17)
    p = lambda x: col(dates.partial_date(L(x), as_of))
    assert [p("Jan 2021"), p("january 2021"), p("3/2020"), p("2020"), p("Present"), p("x")] == [
        dt.date(2021, 1, 1), dt.date(2021, 1, 1), dt.date(2020, 3, 1), dt.date(2020, 1, 1), dt.date(2024, 5, 1), None
    ]


def test_character_references(col):
    read = lambda x: col(text.unescape(F.lit(x)))
    assert read("caf&#233; &#x1F642;&#X41;&amp;#65; &lt;b&gt;") == "café 🙂A&#65; <b>"
    assert read("&#0; &#xD800; &#99999999; &#; &#x110000;") == "&#0; &#xD800; &#99999999; &#; &#x110000;"
    assert read("plain") == "plain" and col(text.unescape(F.lit(None).cast("string"))) is None
