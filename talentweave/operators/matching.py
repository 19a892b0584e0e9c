"""Ranking of postings for profiles: vectors, skills, experience, reasons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from talentweave.functions.text import cosine, distinct_sorted, fold
from talentweave.operators.annotate import salary
from talentweave.operators.dedupe import dedupe_postings
from talentweave.operators.filters import filter_postings

# Weights of the three scores, and of skills by kind.
WEIGHTS = {"embedding": 0.68, "skill": 0.22, "experience": 0.10}
REQUIRED, PREFERRED, OTHER = 1.0, 0.55, 0.75
#: Profiles to a block; every posting meets every block.
BLOCK = 256
#: A table of at most so many profiles is broadcast in its blocks.
BROADCAST_PROFILES = 10_000

Encoder = Callable[[pd.Series], np.ndarray]


def normalized_weights(weights: dict[str, float] | None = None) -> dict[str, float]:
    """Divided by their sum; the defaults where the sum is not positive."""
    weights = weights or WEIGHTS
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else dict(WEIGHTS)


def hashed_vectors(texts: pd.Series, dims: int = 256) -> np.ndarray:
    """Default encoder: signed hashed counts of words, of unit length (zero for empty texts)."""
    out = np.zeros((len(texts), dims))
    for row, text in zip(out, texts.fillna(""), strict=True):
        words = pd.Series(str(text).lower().split(), dtype=object)
        if len(words):
            h = pd.util.hash_array(words.to_numpy())
            np.add.at(row, (h % dims).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def encode(df: DataFrame, text: str = "summary_text", out: str = "embedding", encoder: Encoder = hashed_vectors) -> DataFrame:
    """Vectors of the texts that have none yet; others keep theirs."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            lacks = np.flatnonzero(texts.notna())
            new = [None] * len(texts)
            if len(lacks):
                for i, vector in zip(lacks.tolist(), encoder(texts.iloc[lacks].reset_index(drop=True)), strict=True):
                    new[i] = vector
            yield pd.Series(new, dtype=object)

    # the function is called for every row, so what it must not encode is handed over as null
    given = F.col(out).cast("array<double>") if out in df.columns else F.lit(None).cast("array<double>")
    return df.withColumn(out, F.coalesce(given, vectors(F.when(given.isNull(), F.coalesce(text, F.lit(""))))))


def experience_score(have: Column, wanted: Column) -> Column:
    return F.when(F.coalesce(wanted, F.lit(0.0)) == 0, 1.0).when(F.coalesce(have, F.lit(0.0)) <= 0, 0.0).otherwise(F.least(have / wanted, F.lit(1.0)))


def weighted_skills(required: Column, preferred: Column, every: Column) -> Column:
    """Array of (skill, weight): required, then preferred that are not required, else all."""
    none = F.array().cast("array<string>")
    required, preferred, every = F.coalesce(required, none), F.coalesce(preferred, none), F.coalesce(every, none)

    def at(c: Column, w: float) -> Column:
        return F.transform(c, lambda s: F.struct(s.alias("skill"), F.lit(w).alias("w")))

    named = F.concat(at(required, REQUIRED), at(F.filter(preferred, lambda s: ~F.array_contains(required, s)), PREFERRED))
    return F.when(F.size(named) > 0, named).otherwise(at(every, OTHER))


def skill_score(weighted: Column, known: Column, has_skills: Column) -> Column:
    """Share of the weight that is matched, a quarter of it by the required ones; ``known``: matched posting skills."""
    total = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x["w"])
    got = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + F.when(F.array_contains(known, x["skill"]), x["w"]).otherwise(0.0))
    must = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + F.when(x["w"] >= REQUIRED, x["w"]).otherwise(0.0))
    must_got = F.aggregate(
        weighted, F.lit(0.0), lambda a,
        x: a + F.when((x["w"] >= REQUIRED) & F.array_contains(known, x["skill"]), x["w"]).otherwise(0.0)
    )
    share = got / F.nullif(total, F.lit(0.0))
    return F.when(
        F.size(weighted) == 0, F.when(has_skills, 0.5).otherwise(0.0)
    ).otherwise(F.coalesce(F.when(must > 0, 0.75 * share + 0.25 * must_got / must).otherwise(share), F.lit(0.0)))


def target_skills(required: Column, preferred: Column, every: Column) -> Column:
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(required, none), F.coalesce(preferred, none))
    return F.when(F.size(both) > 0, distinct_sorted(both)).otherwise(F.coalesce(every, none))


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def reasons() -> Column:
    """Sentences for a scored pair, in fixed order; pay only where it can be read from its text."""
    joined = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    none = F.array().cast("array<string>")
    return F.array_compact(F.array(
        F.concat(F.lit("Semantic fit "), percent(F.col("embedding_score")), F.lit(".")),
        F.concat(F.lit("Skill overlap "), percent(F.col("skill_score")), F.lit(", "), F.size("matched_skills").cast("string"), F.lit(" matched.")),
        F.concat(F.lit("Experience "), percent(F.col("experience_score")), F.lit(".")),
        F.when(F.size("matched_skills") > 0, F.concat(F.lit("Matched: "), joined(F.col("matched_skills"), 8), F.lit("."))),
        F.when(
            F.size("missing_skills") > 0, F.concat(F.lit("Missing: "), joined(F.col("missing_skills"), 8), F.lit("."))
        ).otherwise(F.when(F.size(F.coalesce("required_skills", none)) > 0, "No skill gap.")),
        F.when(F.size("matched_clearance") > 0, F.concat(F.lit("Clearance: "), joined(F.col("matched_clearance"), 8), F.lit("."))).when(
            F.size("clearance_terms") > 0, F.concat(F.lit("Needs clearance: "), joined(F.col("clearance_terms"), 8), F.lit("."))
        ),
        F.concat(F.lit("Pay: "), salary(F.coalesce("salary_text", F.lit("")))["display"], F.lit(".")),
    ))


def pairs(profiles: DataFrame, postings: DataFrame) -> DataFrame:
    """Every posting beside every profile (columns p_...), by blocks of profiles.

    The profiles are the stated queries.  They are counted and dealt to blocks; postings meet a block as a whole,
    broadcast only if the profiles are few enough.
    """
    n = profiles.count()
    blocks = max(1, -(-n // BLOCK))
    own = F.struct(*[F.col(c).alias(f"p_{c}") for c in profiles.columns])
    dealt = profiles.select(
        F.pmod(F.xxhash64("profile_id"), F.lit(blocks)).cast("int").alias("_b"), own.alias("_p")
    ).groupBy("_b").agg(F.collect_list("_p").alias("_ps"))
    sent = postings.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = sent.join(F.broadcast(dealt) if n <= BROADCAST_PROFILES else dealt.hint("shuffle_hash"), "_b")
    return met.withColumn("_p", F.explode("_ps")).select(*postings.columns, "_p.*")


def prepared(profiles: DataFrame, postings: DataFrame, skill_pairs: DataFrame | None) -> tuple[DataFrame, DataFrame, Callable[[Column], Column]]:
    """Profiles with the names they cover, postings with their weighted skills, and how a posting's name is looked up."""
    none = F.array().cast("array<string>")
    name: Callable[[Column], Column] = fold
    if skill_pairs is not None:
        # each profile's skills become the posting-side names they cover, once, before any pairing
        cover = profiles.select(
            "profile_id", F.explode("skills").alias("left")
        ).join(skill_pairs.hint("merge"), "left").groupBy("profile_id").agg(F.collect_set("right").alias("covered"))
        profiles = profiles.join(cover.hint("merge"), "profile_id", "left").withColumn("covered", F.coalesce("covered", none))
        name = lambda s: s
    else:
        profiles = profiles.withColumn("covered", F.transform(F.coalesce("skills", none), fold))
    every = F.concat(F.coalesce("required_skills", none), F.coalesce("preferred_skills", none), F.coalesce("skills", none))
    three = F.col("required_skills"), F.col("preferred_skills"), F.col("skills")
    return profiles, postings.withColumns(
        {"_weighted": weighted_skills(*three), "_target": target_skills(*three), "_every": F.array_distinct(every)}
    ), name


def _scored(rows: DataFrame, name: Callable[[Column], Column], weights: dict[str, float]) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_known", F.filter("_every", lambda s: F.array_contains(F.col("p_covered"), name(s))))
    rows = rows.withColumns({
        "embedding_score": cosine(F.col("p_embedding"), F.col("embedding")),
        "skill_score": skill_score(F.col("_weighted"), F.col("_known"), F.size(F.coalesce("p_skills", none)) > 0),
        "experience_score": experience_score(F.col("p_experience_years"), F.col("experience_years")),
    })
    return rows.withColumn(
        "score",
        F.col("embedding_score") * weights["embedding"] + F.col("skill_score") * weights["skill"] + F.col("experience_score") * weights["experience"]
    )


def score_pairs(profiles: DataFrame, postings: DataFrame, skill_pairs: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Scores of all pairs.  ``skill_pairs`` (left: profile's, right: posting's) says which names are equivalent; without
    it equal folded names are."""
    profiles, postings, name = prepared(profiles, postings, skill_pairs)
    return _scored(pairs(profiles, postings), name, normalized_weights(weights))


def vector_rows(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column; zeros for vectors that are null or of another length."""
    column = vectors.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) * ~np.asarray(column.is_null())
    out = np.zeros((len(column), dim))
    fits = np.flatnonzero(sizes == dim)
    if dim and len(fits):
        out[fits] = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def _skill_shares(people: pa.Table, jobs: pa.Table) -> np.ndarray:
    """Skill scores of all postings (rows) for all profiles (columns), by products of small matrices."""
    covered = people.column("p_covered").to_pylist()
    place = {x: i for i, x in enumerate(sorted({x for xs in covered for x in xs}))}
    has = np.zeros((len(place), len(covered)))
    for j, xs in enumerate(covered):
        has[[place[x] for x in xs], j] = 1
    lists = jobs.column("names").combine_chunks()
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    at = np.array([place.get(x, -1) for x in lists.flatten().to_pylist()], np.int64)
    w = jobs.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    must = np.where(w >= REQUIRED, w, 0)
    n = len(lists)
    total, needed = np.bincount(of, w, n), np.bincount(of, must, n)
    share, first = np.zeros((n, len(covered))), np.zeros((n, len(covered)))
    for s in range(0, n, 1024):
        some = (of >= s) & (of < s + 1024) & (at >= 0)
        for out, value in ((share, w), (first, must)):
            table = np.zeros((min(1024, n - s), len(place)))
            np.add.at(table, (of[some] - s, at[some]), value[some])
            out[s : s + 1024] = table @ has
    share /= np.maximum(total, 1e-300)[:, None]
    share = np.where((needed > 0)[:, None], 0.75 * share + 0.25 * first / np.maximum(needed, 1e-300)[:, None], share)
    blank = np.where(people.column("p_any").to_numpy(zero_copy_only=False), 0.5, 0.0)
    return np.where((np.bincount(of, minlength=n) == 0)[:, None], blank[None], share)


def searched(left: DataFrame, right: DataFrame, k: int, weights: dict[str, float], order: tuple[str, ...], margin: float = 1e-9) -> DataFrame:
    """(p_profile_id, id, score): of each block of postings the k best (and what is as good within ``margin``) of each profile.

    A block of postings (``left``, by b and q) meets a block of profiles (``right``, by p_b and p_q) as matrices.  Of
    postings that are alike in all that scores depend on only the first k by ``order`` take part, so that copies
    can't crowd in.
    """
    kinds = left.schema["id"].dataType, right.schema["p_profile_id"].dataType
    id_type, profile_type = (to_arrow_type(x) for x in kinds)
    orders = [f"o_{c}" for c in order]

    def search(jobs: pa.Table, people: pa.Table) -> pa.Table:
        who, what, worth = pa.array([], profile_type), pa.array([], id_type), pa.array([], pa.float64())
        if jobs.num_rows and people.num_rows:
            ranked = jobs.select(orders).to_pandas().sort_values(orders, ascending=False, na_position="last", kind="stable").index.to_numpy()
            jobs = jobs.take(pa.array(ranked))
            sizes = [len(x) for col in (people.column("p_e"), jobs.column("e")) for x in col if x.is_valid]
            dim = max(sizes, default=0)
            vectors = vector_rows(jobs.column("e"), dim)
            kind = pd.DataFrame(
                {
                    "u": [x.tobytes() for x in vectors], "n": jobs.column("names").to_pylist(),
                    "w": jobs.column("weights").to_pylist(), "y": jobs.column("years").to_pandas()
                }
            )
            again = kind.assign(n=kind.n.map(str), w=kind.w.map(str)).groupby(["u", "n", "w", "y"], dropna=False).cumcount().to_numpy()
            stay = np.flatnonzero(again < k)
            jobs = jobs.take(pa.array(stay))
            score = weights["embedding"] * np.clip(
                unit(vectors[stay]) @ unit(vector_rows(people.column("p_e"), dim)).T, 0, 1
            ) + weights["skill"] * _skill_shares(people, jobs)
            wanted, have = (
                np.nan_to_num(t.column(c).to_numpy(zero_copy_only=False).astype(float)) for t,
                c in ((jobs, "years"), (people, "p_years"))
            )
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(have[None] <= 0, 0.0, np.minimum(have[None] / wanted[:, None], 1.0))
            score += weights["experience"] * np.where(wanted[:, None] == 0, 1.0, part)
            cut = np.partition(score, len(stay) - k, axis=0)[len(stay) - k] if len(stay) > k else score.min(0)
            rows, columns = np.nonzero(score >= cut[None] - margin)
            who, what = people.column("p_profile_id").take(pa.array(columns)), jobs.column("id").take(pa.array(rows))
            worth = pa.array(score[rows, columns])
        return pa.table({"p_profile_id": who, "id": what, "score": worth})

    return left.groupBy("b", "q").cogroup(right.groupBy("p_b", "p_q")).applyInArrow(
        search, f"p_profile_id {kinds[1].simpleString()}, id {kinds[0].simpleString()}, score double"
    )


def search_rows(profiles: DataFrame, postings: DataFrame, order: tuple[str, ...], asks: int) -> tuple[DataFrame, DataFrame]:
    """What ``searched`` needs of postings and of profiles (both ``prepared``), but for b and p_b: postings ``asks`` times."""
    left = postings.select(
        *[F.col(c).alias(f"o_{c}") for c in order], "id", F.col("embedding").cast("array<double>").alias("e"),
        F.col("experience_years").cast("double").alias("years"), "names", "weights", *[c for c in ("b",) if c in postings.columns],
        F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("q")
    )
    right = profiles.select(
        F.col("profile_id").alias("p_profile_id"), F.col("embedding").cast("array<double>").alias("p_e"),
        F.col("experience_years").cast("double").alias("p_years"), F.col("covered").alias("p_covered"),
        (F.size(F.coalesce("skills", F.array().cast("array<string>"))) > 0).alias("p_any"), dealt_to(F.col("profile_id"), asks).alias("p_q")
    )
    return left, right


def dealt_to(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def candidates(profiles: DataFrame, postings: DataFrame, k: int, weights: dict[str, float], order: tuple[str, ...], margin: float = 1e-9) -> DataFrame:
    """(p_profile_id, id, score): for each profile and block of postings those that can be among the k best of all.

    Every posting's score is worked out.  ``profiles`` and ``postings`` are those of ``prepared``, with the posting's
    ``names`` and ``weights``.
    """
    blocks = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    asks = max(1, -(-profiles.count() // (8 * BLOCK)))
    left, right = search_rows(profiles, postings.withColumn("b", dealt_to(F.col("id"), blocks)), order, asks)
    right = right.withColumn("p_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return searched(left, right, k, weights, order, margin)


def named(postings: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """Postings of ``prepared`` with the names that profiles may cover and their weights as columns."""
    return postings.withColumns({"names": F.transform("_weighted", lambda x: name(x["skill"])), "weights": F.transform("_weighted", lambda x: x["w"])})


def best_matches(
    profiles: DataFrame, postings: DataFrame, k: int = 20, skill_pairs: DataFrame | None = None,
    weights: dict[str, float] | None = None, order: tuple[str, ...] = ("last_seen_at", "id"), digits: int | None = None
) -> DataFrame:
    """The k best postings of each profile, scored and ranked as by ``score_pairs`` and ``top_k``.

    Matrices find the candidates (a few times k a profile); only these become rows and are scored as columns.  With
    ``digits`` scores are rounded before they are ranked.  Postings and profiles have one row an id.
    """
    w, margin = normalized_weights(weights), 1e-9 + (10.0**-digits if digits is not None else 0.0)
    profiles, postings, name = prepared(profiles, postings, skill_pairs)
    found = candidates(profiles, named(postings, name), k, w, order, margin)
    return ranked_rows(profiles, postings, found, name, w, k, order, digits, margin)


def nearest_of_all(found: DataFrame, k: int, margin: float) -> DataFrame:
    """(p_profile_id, id): of the candidates of all blocks those that can be among a profile's k best.

    Every block sends its own k best, so candidates are as many times k a profile as there are blocks.  They are ids and
    scores, and are thinned out as such: a vector is joined only to what stays.
    """
    best = Window.partitionBy("p_profile_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = found.withColumn("_least", F.nth_value("score", k).over(best))
    return least.where(F.col("_least").isNull() | (F.col("score") >= F.col("_least") - margin)).select("p_profile_id", "id")


def ranked_rows(
    profiles: DataFrame, postings: DataFrame, found: DataFrame, name: Callable[[Column], Column], weights: dict[str, float], k: int,
    order: tuple[str, ...], digits: int | None, margin: float
) -> DataFrame:
    """The candidates ``found`` (with scores that are right within ``margin``) as rows, scored as columns and ranked."""
    own = profiles.select(*[F.col(c).alias(f"p_{c}") for c in profiles.columns])
    near = nearest_of_all(found, k, margin)
    rows = postings.hint("merge").join(near.hint("merge"), "id").join(own.hint("merge"), "p_profile_id")
    scored = _scored(rows, name, weights)
    return top_k(scored if digits is None else scored.withColumn("score", F.round("score", digits)), k, order)


def top_k(scored: DataFrame, k: int | None = 20, order: tuple[str, ...] = ("last_seen_at", "id")) -> DataFrame:
    """The k best postings of each profile, ranked; ties to the last seen and the larger id."""
    w = Window.partitionBy("p_profile_id").orderBy(F.desc("score"), *[F.desc(c) for c in order])
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def explain(ranked: DataFrame) -> DataFrame:
    """Matched and missing skills, common clearance and reasons for the pairs that stayed."""
    none = F.array().cast("array<string>")
    mine = F.transform(F.coalesce("p_clearance_terms", none), fold)
    rows = ranked.withColumns({
        "matched_skills": F.filter("_target", lambda s: F.array_contains(F.col("_known"), s)),
        "missing_skills": F.filter("_target", lambda s: ~F.array_contains(F.col("_known"), s)),
        "matched_clearance": F.array_sort(F.filter(F.coalesce("clearance_terms", none), lambda t: F.array_contains(mine, fold(t)))),
    })
    return rows.withColumn("reasons", reasons())


def rank_matches(
    profiles: DataFrame, postings: DataFrame, *, k: int | None = 20, weights: dict[str, float] | None = None,
    skill_pairs: DataFrame | None = None, encoder: Encoder = hashed_vectors, **filters
) -> DataFrame:
    """Deduplicate, filter, encode what lacks a vector, score, rank, explain.

    Activity and source filters go below the deduplication; all others judge its winners.
    """
    below = {x: filters.pop(x) for x in ("source_ids", "active_only") if x in filters}
    rows = filter_postings(dedupe_postings(filter_postings(postings, **below)), **filters)
    profiles, rows = encode(profiles, encoder=encoder), encode(rows, encoder=encoder)
    ranked = top_k(score_pairs(profiles, rows, skill_pairs, weights), None) if k is None else best_matches(profiles, rows, k, skill_pairs, weights)
    return explain(ranked).withColumnsRenamed({"p_profile_id": "profile_id", "id": "posting_id"})


def browse_postings(postings: DataFrame, dedupe: bool = True, **filters) -> DataFrame:
    """The filtered view without ranking."""
    return filter_postings(dedupe_postings(postings) if dedupe else postings, **filters)
