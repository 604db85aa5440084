import collections
import math

import pytest
from pyspark.sql import functions as F

from wattframe.llm import language

SF = "/root/testdata/sf0.01"
ROWS = "key long, text string, declared string, suffix string, domain string, host string, guess string, lang int"


def asked(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0"), 100)


def test_held_out_texts(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1")
    rows = docs.select(F.col("doc_id").alias("key"), "text", *(F.lit(None).alias(c) for c in ("declared", "suffix", "domain", "host")))
    got = language.identify(rows, model).join(docs.withColumnRenamed("lang", "true"), F.col("key") == F.col("doc_id")).collect()
    assert len(got) == docs.count()
    assert sum(r.text_lang == r.true for r in got) / len(got) > 0.97
    assert not any(r.rejected for r in got if sum(c.isalpha() for c in r.text) > 20)


def test_pages(spark):
    from wattframe.llm.queries import op5_language

    got = {r.page_id: r for r in op5_language(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    right = [f'lang="{got[p.page_id].lang}"' in p.html for p in pages]
    assert sum(right) / len(right) > 0.97 and all(0.25 <= r.probability <= 1 for r in got.values())


def test_fusion(spark, model):
    """The posterior, worked out in plain Python."""
    english = next(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND n_chars > 400").collect())
    rows = [(1, "", "fr", "fr", "a.fr", "x.a.fr"), (2, None, "fr", "fr", "a.fr", "x.a.fr"), (3, "", None, "fr", "a.fr", "x.a.fr"), (4, "", None, "fr", "b.fr", "b.fr"),
            (5, english, "fr", "fr", "a.fr", "x.a.fr"), (6, "", None, None, None, None), (7, "", "xx", "com", "c.com", "c.com"), (7, "", "de", "com", "c.com", "c.com")]
    names = [*model.languages, "und"]
    texts = {r.key: r for r in language._text_scores(asked(spark, rows[:7]).drop("guess", "lang"), model).collect()}
    local, guess = [], []
    for key, _, declared, *_ in rows:
        says = [0.0 if declared not in model.languages else math.log(0.9 if x == declared else 0.1 / 3) for x in names]
        local.append([a + b for a, b in zip(texts[key].scores, says)])
        guess.append(names[local[-1].index(max(local[-1]))])
    counts = collections.defaultdict(collections.Counter)
    for (_, _, _, s, d, h), g in zip(rows, guess):
        for name, value in (("all", 1), ("s", s), ("d", d), ("h", h)):
            if value:
                counts[name, value][g] += 1
    want = []
    for (key, _, _, s, d, h), scores, g in zip(rows, local, guess):
        base = {x: (counts["all", 1][x] + 1) / (len(rows) + 5) for x in names}
        smooth = lambda c, w: {x: (c[x] + 5 * w[x]) / (sum(c.values()) + 5) for x in names}
        host = collections.Counter(counts["h", h]) if h else collections.Counter()
        if h:
            host[g] -= 1
        prior = smooth(host, smooth(counts["d", d] if d else collections.Counter(), base))
        suffix = smooth(counts["s", s] if s else collections.Counter(), base)
        total = [a + math.log(prior[x]) + math.log(suffix[x] / base[x]) + (math.log(1e-4) if x == "und" else 0) for a, x in zip(scores, names)]
        best = max(total)
        want.append((key, names[total.index(best)], round(1 / sum(math.exp(t - best) for t in total), 9)))
    got = language.identify(asked(spark, rows), model).collect()
    assert sorted((r.key, r.lang, round(r.probability, 9)) for r in got) == sorted(want)
    assert {r.key: r.rejected for r in got} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True}
    assert [r.lang for r in got if r.key == 5] == ["en"]


def test_unknown_script_and_empty_tables(spark, model):
    got = {r.key: r for r in language.identify(asked(spark, [(1, "漢字仮名交じり文の例文です" * 20, "en", None, None, "h"), (2, "%% 123 --", "en", None, None, "h")]), model).collect()}
    assert got[1].rejected and got[1].lang == "und" and got[2].rejected
    assert language.identify(asked(spark, []), model).count() == 0
    none = language.fit(spark.read.parquet(f"{SF}/documents.parquet").limit(0))
    assert [r.rejected for r in language.identify(asked(spark, [(1, "text", "en", None, None, None)]), none).collect()] == [True]


def test_page_rows(spark):
    html = '<HTML  class=x lang=DE-at><script>var a="<p>";</script><p>Gr&uuml;n &#228;<!-- no --> Tee</p>'
    rows = spark.createDataFrame([(1, "https://u@Shop.example.co.uk:80/x", html), (2, None, None), (3, "no address", "<html lang=''>")], "page_id long, url string, html string")
    got = {r.key: r for r in language.page_rows(rows).collect()}
    assert (got[1].declared, got[1].suffix, got[1].domain, got[1].host) == ("de", "uk", "co.uk", "shop.example.co.uk")
    assert got[1].text.split() == ["Gr", "n", "Tee"]
    assert got[2].text == "" and got[2].declared is None and got[2].host is None and got[3].declared is None
