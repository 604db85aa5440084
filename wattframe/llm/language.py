"""Language ID by Bayesian evidence fusion.

Four kinds of evidence are added as logarithms: the text's likelihood under a model of byte trigrams per language,
the language that the markup declares, the address's suffix, and a prior of the host. Priors are smoothed along
all -> domain -> host, from counts that grouped aggregations give; a page's own guess is left out of its host's.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .batches import bounded, slices
from .words import column_bytes

#: The model is fitted on so many labelled texts of each language at most, those with the smallest hashed ids.
TEXTS_PER_LANGUAGE = 200
#: Hashed trigrams that the model tells apart.
FEATURES = 1 << 16
#: Added to each count.
SMOOTHING = 0.5
#: Each byte lies in three trigrams, so their evidence is not independent.
TEMPER = 3.0
#: Log probabilities are whole numbers of this size, so that sums don't depend on their order.
UNIT = 1e-4
#: How often markup declares the true language, where it declares any of those known.
DECLARED_RIGHT = 0.9
#: Pages that a prior from the next wider level counts for.
STRENGTH = 5.0
#: Prior of text in none of the languages, whose trigrams are all equally likely.
UNKNOWN_PRIOR = 1e-4
UNKNOWN = "und"
#: The rows of a host are dealt to so many tasks when its counts are joined.
SALTS = 8

_letter = np.full(256, 32, np.uint8)
_letter[97:123] = np.arange(97, 123)
_letter[65:91] = np.arange(97, 123)
_letter[128:] = np.arange(128, 256)


@dataclass
class Model:
    """``scores[i]``: log probabilities of the features in ``languages[i]``, in units."""

    languages: list[str]
    scores: np.ndarray


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts and the text of each. Everything but letters counts as a blank; only blanks count not."""
    data, offsets = column_bytes(texts)
    data = _letter[data].astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    packed = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    inside = (owner[:-2] == owner[2:]) & (packed != 0x202020)
    mixed = packed[inside] * np.uint32(0x9E3779B1)
    return ((mixed ^ (mixed >> 15)) & np.uint32(FEATURES - 1)).astype(np.int64), owner[:-2][inside]


def fit(labelled: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages in ``labelled``, from ``per_language`` texts of each at most.

    Rows with a null language, text or id don't count. What reaches the driver is bounded by ``FEATURES`` times languages.
    """
    from pyspark.sql import Window

    known = bounded(labelled).where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    place = F.row_number().over(Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col))
    chosen = known.select(id_col, lang_col).withColumn("_place", place).where(F.col("_place") <= per_language)
    chosen = chosen.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).distinct()
    texts = known.where(F.col(text_col).isNotNull()).join(
        F.broadcast(chosen), (F.col(id_col) == F.col("_id")) & (F.col(lang_col) == F.col("_lang")), "left_semi")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, at = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
                features, owner = trigrams(part.column("text"))
                cells, n = np.unique(at[owner] * FEATURES + features, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in cells // FEATURES], pa.string()), pa.array(cells % FEATURES, pa.int64()), pa.array(n, pa.int64())],
                    ["lang", "feature", "n"])

    counted = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, feature bigint, n bigint")
    rows = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = rows["lang"].to_pylist()
    languages = sorted(set(names))
    counts = np.zeros((len(languages), FEATURES))
    index = {lang: i for i, lang in enumerate(languages)}
    counts[[index[x] for x in names], rows["feature"].to_numpy()] = rows["n"].to_numpy()
    chances = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * FEATURES)
    return Model(languages, np.rint(np.log(chances) / UNIT).astype(np.int32))


def _text_scores(rows: DataFrame, model: Model) -> DataFrame:
    """``key, declared, suffix, domain, host, n_features, scores``; scores of the languages, then of none of them."""
    shared = bounded(rows).sparkSession.sparkContext.broadcast(model.scores)  # FEATURES numbers for each language
    flat = round(math.log(1 / FEATURES) / UNIT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                features, owner = trigrams(part.column("text"))
                n = np.bincount(owner, minlength=part.num_rows)
                edges = np.r_[0, np.cumsum(n)]
                table = np.zeros((part.num_rows, len(scores) + 1), np.int64)
                for i, line in enumerate(scores):
                    sums = np.r_[0, np.cumsum(line[features], dtype=np.int64)]
                    table[:, i] = sums[edges[1:]] - sums[edges[:-1]]
                table[:, -1] = n * flat
                lists = pa.array((table * (UNIT / TEMPER)).tolist(), pa.list_(pa.float64()))
                others = ["key", "declared", "suffix", "domain", "host"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(n, pa.int64()), lists], [*others, "n_features", "scores"])

    return rows.mapInArrow(run, "key bigint, declared string, suffix string, domain string, host string, n_features bigint, scores array<double>")


def _best(languages: Column, scores: Column) -> Column:
    """The language with the highest score, the first of equals."""
    return F.get(languages, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """``key, lang, probability, text_lang, rejected`` for each row of ``key, text, declared, suffix, domain, host``.

    ``lang`` has the highest posterior, ``text_lang`` the highest likelihood of the text alone. A row is rejected if
    its text has no letters or is likelier to be in none of the model's languages (``und``).

    A null text has no letters and is judged by the other evidence; a null or unknown declaration, a null suffix,
    domain or host say nothing. Repeated rows and keys stay as they are and count for their hosts; an empty table
    gives no rows. A model without languages rejects every row.
    """
    names = [*model.languages, UNKNOWN]
    languages, n = F.array(*map(F.lit, names)), len(model.languages)
    kinds = {"key": "bigint", "text": "string", "declared": "string", "suffix": "string", "domain": "string", "host": "string"}
    read = _text_scores(rows.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items())), model)
    right, wrong = math.log(DECLARED_RIGHT), math.log((1 - DECLARED_RIGHT) / max(1, n - 1))
    is_known = F.coalesce(F.col("declared").isin(model.languages) if n else F.lit(False), F.lit(False))
    says = F.transform(languages, lambda x: F.when(~is_known, 0.0).when(x == F.col("declared"), right).otherwise(wrong))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    read = read.withColumn("local", add("scores", says)).withColumn("guess", _best(languages, F.col("local")))
    read = cut_lineage(read.withColumn("text_lang", _best(languages, F.col("scores"))))

    counted = F.array(*(F.sum((F.col("guess") == x).cast("double")) for x in names))
    total = F.aggregate("_all", F.lit(0.0), lambda a, x: a + x)
    everything = read.agg(counted.alias("_all"))
    base = F.transform("_all", lambda x: (F.coalesce(x, F.lit(0.0)) + 1) / (total + len(names)))
    unknown = F.transform(languages, lambda x: F.when(x == UNKNOWN, math.log(UNKNOWN_PRIOR)).otherwise(0.0))

    def smoothed(counts: Column, wider: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, wider, lambda c, w: (c + w * STRENGTH) / (size + STRENGTH))

    def known_of(rows: DataFrame, key: str, out: str) -> DataFrame:
        """Rows with the counts of their suffix, domain or host; zeros without one. Hot ones are salted."""
        counts = read.where(F.col(key).isNotNull()).groupBy(key).agg(counted.alias(out))
        salted = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        chance = F.xxhash64("key")
        # A null key becomes one that matches nothing and differs from row to row.
        rows = rows.withColumn(key, F.coalesce(key, F.concat(F.lit("\n"), chance))).withColumn("_salt", F.pmod(chance, F.lit(SALTS)).cast("int"))
        return rows.join(salted, [key, "_salt"], "left").drop("_salt").withColumn(out, F.coalesce(out, F.array_repeat(F.lit(0.0), len(names))))

    joined = read.select("key", "n_features", "text_lang", "local", "guess", F.col("host").isNotNull().alias("_hosted"), "suffix", "domain", "host")
    for key in ("suffix", "domain", "host"):
        joined = known_of(joined, key, f"_{key}")
    joined = joined.crossJoin(F.broadcast(everything)).withColumn("_base", base)  # one row
    own = F.transform(languages, lambda x: F.when((x == F.col("guess")) & F.col("_hosted"), 1.0).otherwise(0.0))
    others = F.zip_with("_host", own, lambda a, b: a - b)
    prior = smoothed(others, smoothed(F.col("_domain"), F.col("_base")))
    # How likely the suffix is in a language, against how likely it is at all.
    ratio = F.zip_with(smoothed(F.col("_suffix"), F.col("_base")), F.col("_base"), lambda a, b: F.log(a / b))
    score = add(add("local", F.transform(prior, lambda x: F.log(x))), add(ratio, unknown))
    joined = joined.withColumn("_score", score).withColumn("_top", F.array_max("_score"))
    weight = F.aggregate(F.transform("_score", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, x: a + x)
    lang = _best(languages, F.col("_score"))
    return joined.select("key", lang.alias("lang"), (1 / weight).alias("probability"), "text_lang",
                         ((F.col("n_features") == 0) | (lang == UNKNOWN)).alias("rejected"))


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as ``identify`` takes them: text without markup, declared language, and parts of the address."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    said = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    some = lambda c: F.when(c != "", c)
    return pages.select(
        F.col(id_col).alias("key"), text.alias("text"), some(said).alias("declared"), some(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"),
        some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"), some(host).alias("host"))
