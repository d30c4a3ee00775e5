"""Lines of pages that are long or broken."""

import os
import re
import sys
import time

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from quillgraph.llm import line_dedup as L  # noqa: E402

FLAGS = re.ASCII


def plain_lines(html):
    text = re.sub(L.HIDDEN, "\n", html or "", flags=FLAGS)
    text = re.sub(L.TAGS, "", re.sub(L.BREAKS, "\n", text, flags=FLAGS), flags=FLAGS)
    return [x for x in (x.strip(" \t") for x in re.split("[\r\n]+", text)) if x]


def lines(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", L.html_lines(F.col("html")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_equal_to_the_plain_patterns(spark):
    import random

    rng = random.Random(8)
    parts = ["<!--", "-->", "<script>", "<SCRIPT x=1>", "</script>", "</Script >", "</script", "<style>", "</style>", "<p>", "</p>", "<b", ">", "a", " b ", "\n", "<", "<!x", "<? y", "é", "<div class=q>", "<scripted>"]
    pages = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(150)] + ["".join(rng.choices(parts[:9] + ["w\n"], k=600)) for _ in range(30)]
    pages += ["<!-- " * 200 + "--> x <!-- " + "y<!--" * 100, "<script>" * 100 + "a</script>b" + "<script>c" * 100, "", "x" * 50]
    assert lines(spark, pages) == [plain_lines(p) for p in pages]


@pytest.mark.parametrize("part", ["<!-- ", "<script ", "<! ", "<style>", "<div ", "<a x", "</script <script "])
def test_a_megabyte_of_what_nothing_closes(spark, part):
    page = part * (1_000_000 // len(part))
    began = time.perf_counter()
    (got,) = lines(spark, [page])
    assert time.perf_counter() - began < 10 and got == ([] if ">" in part else [page.strip(" ")])
