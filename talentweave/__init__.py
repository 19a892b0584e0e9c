"""Matching postings and profiles, and preparing text collections, as Spark jobs."""
