"""References and divs of pages natively, against Python's rules, on odd pages."""

import random
import re

from pyspark.sql import functions as F

from parley.operators import cues
from parley.plans import catalog, more  # noqa: F401  (registers the queries)
from parley.sources import pages


def decoded(text):
    text = re.sub(r"&#(\d+);", lambda m: chr(int(m[1])) if int(m[1]) < 0x110000 else m[0], text)
    text = re.sub(r"&#x([0-9a-f]+);", lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else m[0], text, flags=re.I)
    return re.sub(r"&([a-z]+);", lambda m: pages.ENTITIES.get(m[1].lower(), m[0]), text, flags=re.I)


def column(spark, rows, made):
    df = spark.createDataFrame(list(enumerate(rows)), "k long, t string")
    return [r.x for r in df.select("k", made(F.col("t")).alias("x")).orderBy("k").collect()]


def test_references(spark):
    rng = random.Random(3)
    parts = ["&", "#", "x", ";", "38", "&#65;", "&#x1F600;", "&#X41;", "&amp;", "&AMP;", "lt;", "&nbsp;", "&bogus;", "&#38;", "&#0000097;", "&#99999999999999999999999;", "&#x110000;", "&#xFFFFFFFFFFFFFFFFFFFF;", "é", "\n", "a b", "&quot;", "$1\\"]
    rows = ["", "&", "plain", "&#38;#x41;", "&#38;lt;", *("".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(400))]
    assert column(spark, [*rows, None], pages.decode_entities) == [*map(decoded, rows), None]
    assert column(spark, ["&#xD800;&#55296;x"], pages.decode_entities) == ["��x"]


def test_divs(spark):
    rng = random.Random(4)
    parts = ['<div class="ad">', '<DIV id=1 class="x ad y">', '<div class="bad">', "<div>", "</div>", "</DIV >", "<divx>", "té\nxt", "<p>", '<div data="a>b" class="AD">', "<div", '"', '<div class="a" class="ad">', "</div"]
    rows = ["", "x", '<div class="ad"></div>x', '<div class="ad">a<div>b', *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(600))]
    assert column(spark, [*rows, None], lambda c: pages.div_by_class(c, "ad")) == [pages.inner_div(t, "ad") for t in [*rows, None]]


def test_no_page_goes_through_a_worker(spark):
    for name in ("html_sentence_cues", "subtitle_page_cues", "html_br_cues", "page_ad_blocks"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_rewrites_are_tried_where_they_can_match(spark):
    rng = random.Random(5)
    parts = ["b", "/b", "[x]", "[", "(", ")", "(JOHN", "ANN)", "|@", "Bob:", "Bob: ", " ALL : ", '"', "“hm”", '"word"', "aIIb", "II", "aIb", "bIcId", "l'm", "I'll", " l ", "it 's", "' t", "\n", "  ", " ,", "…", "Él"]
    rows = ["", " ", *("".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(400)), None]

    def plain(c):
        for pattern, to, _ in cues.REWRITES:
            c = F.regexp_replace(c, "(?U)" + pattern if r"\s" in pattern and "(?i)" not in pattern else pattern, to)
        return F.trim(c)

    assert all(rare for _, _, rare in cues.REWRITES[:-2])
    assert column(spark, rows, cues.clean_cue) == column(spark, rows, plain)
