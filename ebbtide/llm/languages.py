"""Language by Bayesian fusion of text, declared language and address (operator 8).

Each language has a model of hashed letter triplets, learned from the texts that declare
it; every declared one has a model. The posterior of a row multiplies its text's likelihood, how far a declaration can be
trusted, and a prior of its host. Host priors are counts of what the texts say, smoothed
by the parent domain, that by the address suffix, that by all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import as_bytes, query, stored, table, text_slices, with_column

BUCKETS = 1 << 14
#: A model of fewer triplets is thin: more of it is smoothing than text.
THIN = BUCKETS // 2
#: Triplets of a text count no more than this many independent ones would.
TRUST = 50
#: Rows that a parent's distribution counts for in its child's.
SMOOTHING = 10.0
#: Posterior a kept row needs.
CONFIDENCE = 0.65
#: Language of texts that no model explains better than chance.
UNKNOWN = "und"

# Letters in lower case, everything else below 128 a space.
_FOLD = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if b >= 128 else 32 for b in range(256)], np.uint32)


def triplet_counts(text: bytes) -> np.ndarray:
    """Triplets of letters and single gaps, by bucket."""
    folded = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    folded = folded[np.concatenate([[True], (folded[1:] != 32) | (folded[:-1] != 32)])]
    if len(folded) < 3:
        return np.zeros(BUCKETS, np.int64)
    mixed = (folded[:-2] << np.uint32(16)) + (folded[1:-1] << np.uint32(8)) + folded[2:]
    return np.bincount((mixed * np.uint32(0x9E3779B1)) >> np.uint32(18), minlength=BUCKETS)


def primary(code: str) -> Column:
    """The first part of a language tag, in lower case: en for en-GB."""
    return F.lower(F.regexp_extract(F.col(f"`{code}`"), "^[ ]*([A-Za-z]{2,3})(?:[-_]|$|[ ])", 1))


class Models:
    """Log probabilities of the buckets for each language, and of pure chance."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        smooth = counts + 0.5
        table = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(languages) else np.empty((0, BUCKETS))
        # A row per bucket, so that a text reads the rows of its own triplets alone.
        self.table = np.ascontiguousarray(np.vstack([table, np.full(BUCKETS, -np.log(BUCKETS))]).T)
        self.thin = [c for c, n in zip(languages, counts.sum(axis=1)) if n < THIN]

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Triplets of each text, and its log likelihood in each language, tempered."""
        counts = [triplet_counts(t) for t in as_bytes(texts)]
        n = np.array([c.sum() for c in counts], np.int64)
        likely = np.array([c[used] @ self.table[used] for c in counts for used in [np.flatnonzero(c)]]).reshape(len(counts), -1)
        return n, likely * (np.minimum(n, TRUST) / np.maximum(n, 1))[:, None]


def text_models(docs: DataFrame, text_col: str = "text", declared_col: str = "lang") -> Models:
    """Count triplets by declared language over all rows; each task sends one sum per language and bucket."""
    source = docs.select(F.col(f"`{text_col}`").alias("text"), primary(declared_col).alias("code")).where("code <> ''")
    codes = sorted(r["code"] for r in source.where(F.col("code") != UNKNOWN).select("code").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, texts in text_slices(batch.column(0)):
                for code, text in zip(batch.column(1).slice(start, len(texts)).to_pylist(), as_bytes(texts)):
                    if code != UNKNOWN:
                        sums[code] = sums.get(code, 0) + triplet_counts(text)
        for code, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([code] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], ["code", "bucket", "n"])

    found = source.mapInArrow(run, "code string, bucket bigint, n bigint").groupBy("code", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(codes), BUCKETS))
    if found.num_rows:
        place = {c: i for i, c in enumerate(codes)}
        at = [place[c] for c in found.column("code").to_pylist()]
        counts[at, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return Models(codes, counts)


def _hosts(address: Column) -> tuple[Column, Column, Column]:
    """Host, its last two labels and its last label; a plain name is its own host without suffix."""
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")), address))
    labels = F.split(host, r"\.")
    domain = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    return host, domain, F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise(F.lit(""))


def identified(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", address_col: str = "source", keep: list[str] | None = None, name: str = "found") -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``name``: language, confidence, text_language, n_triplets, kept.

    Kept are rows with letters whose language is known with enough confidence. Where that
    would reject a row that declares a language with a thin model, the declaration decides. A null or
    empty text, or one without letters, gives no evidence: declaration and host decide the
    language, and the row is not kept. A null declaration or address gives no evidence
    either. Without any declared language, every row is unknown. Repeated rows and null ids
    are rows like any other; an empty table gives an empty result.
    """
    models = text_models(docs, text_col, declared_col)
    codes, size = models.languages, len(models.languages)

    def compute(texts: pa.Array) -> pa.Array:
        n, likely = models.evidence(texts)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(list(likely), pa.list_(pa.float64()))], ["n", "likely"])

    kept = docs.columns if keep is None else keep
    needed = list(dict.fromkeys([*kept, declared_col, address_col]))
    inner = {c: f"{c}__own" for c in needed if c in ("evidence", "said", "host", "domain", "suffix", "posterior", "prior", "best", "whole", name)}
    renamed = docs.withColumnsRenamed(inner)
    own = lambda c: inner.get(c, c)
    scored = with_column(renamed, own(text_col), "evidence", "struct<n: bigint, likely: array<double>>", compute, [own(c) for c in needed])
    host, domain, suffix = _hosts(F.col(f"`{own(address_col)}`"))
    scored = stored(scored.withColumns({"said": primary(own(declared_col)), "host": host, "domain": domain, "suffix": suffix}), "evidence")

    # What the texts alone say, as soft counts.
    # Each step is a column of its own: a lambda would compute it again for every language.
    keys = ("said", "host", "domain", "suffix")
    soft = scored.where("evidence.n > 0").select(*keys, "evidence.likely", F.array_max("evidence.likely").alias("top"))
    soft = soft.select(*keys, F.transform("likely", lambda x: F.exp(x - F.col("top"))).alias("raised"))
    soft = soft.select(*keys, "raised", F.aggregate("raised", F.lit(0.0), lambda a, x: a + x).alias("total"))
    soft = soft.select(*keys, *[(F.col("raised")[i] / F.col("total")).alias(f"p{i}") for i in range(size)])
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(size)]
    vector = F.array(*[F.col(f"p{i}") for i in range(size)])
    everything = soft.agg(*[F.coalesce(F.sum(f"p{i}"), F.lit(0.0)) for i in range(size)]).first()
    rows = sum(everything)
    shares = [(x + 1.0 / size) / (rows + 1.0) for x in everything]

    # One row per declared language: what declaring it says of the true one.
    declared = soft.where("said <> ''").groupBy("said").agg(*sums).select("said", vector.alias("said_counts"))
    # A declaration multiplies each language's odds by P(said | language); smoothed by one row.
    said_weight = F.transform("said_counts", lambda x, i: F.log((x + F.lit(0.01)) / (F.element_at(F.array(*[F.lit(float(e)) for e in everything]), i + 1) + F.lit(1.0))))

    def smoothed(counts: Column, parent: Column) -> Column:
        """A child's shares, drawn towards its parent's by SMOOTHING rows."""
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.transform(F.array(n), lambda m: F.zip_with(counts, parent, lambda x, p: (x + SMOOTHING * p) / (m + SMOOTHING)))[0]

    base = F.array(*[F.lit(s) for s in shares])
    level = lambda keys: soft.groupBy(*keys).agg(*sums).select(*keys, vector.alias("c"))
    hosts = stored(level(["suffix", "domain", "host"]), "hosts").where("host is not null")
    domains = hosts.groupBy("suffix", "domain").agg(*[F.sum(F.col("c")[i]).alias(f"p{i}") for i in range(size)]).select("suffix", "domain", vector.alias("d"))
    suffixes = domains.groupBy("suffix").agg(*[F.sum(F.col("d")[i]).alias(f"p{i}") for i in range(size)]).select("suffix", vector.alias("s"))
    priors = hosts.join(domains, ["suffix", "domain"]).join(suffixes, "suffix").select(
        "host", smoothed(F.col("c"), smoothed(F.col("d"), smoothed(F.col("s"), base))).alias("prior")
    )

    joined = scored.join(stored(priors, "priors"), "host", "left").join(stored(declared, "declared"), "said", "left")
    none = F.array(*[F.lit(0.0)] * size)
    prior = F.transform(F.coalesce("prior", base), lambda p: F.log(p))
    joined = joined.withColumn("posterior", F.zip_with(
        F.zip_with("evidence.likely", prior, lambda a, b: a + b), F.coalesce(said_weight, none), lambda a, b: a + b
    ))
    joined = joined.withColumn("best", F.array_max("posterior"))
    raised = F.transform("posterior", lambda x: F.exp(x - F.col("best")))
    joined = joined.withColumn("whole", F.aggregate(raised, F.lit(0.0), lambda a, x: a + x))
    names = F.array(*[F.lit(c) for c in codes])
    likeliest = F.element_at(names, F.array_position("posterior", F.col("best")).cast("int"))
    clear = (likeliest != UNKNOWN) & (1 / F.col("whole") >= CONFIDENCE)
    # A thin model cannot hold its own against better ones; what would be rejected goes by its declaration.
    declares = (F.col("evidence.n") > 0) & ~clear & F.coalesce(F.col("said").isin(models.thin), F.lit(False))
    language = F.when(declares, F.col("said")).otherwise(likeliest)
    said_posterior = F.element_at("posterior", F.array_position(names, F.col("said")).cast("int"))
    confidence = F.when(declares, F.exp(said_posterior - F.col("best"))).otherwise(1.0) / F.col("whole")
    text_language = F.when(F.col("evidence.n") > 0, F.element_at(names, F.array_position("evidence.likely", F.array_max("evidence.likely")).cast("int")))
    found = F.struct(
        language.alias("language"), confidence.alias("confidence"), text_language.alias("text_language"), F.col("evidence.n").alias("n_triplets"),
        ((F.col("evidence.n") > 0) & (clear | declares)).alias("kept"),
    )
    return joined.select(*[F.col(f"`{own(c)}`").alias(c) for c in kept], found.alias(name))


def kept_documents(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", address_col: str = "source") -> DataFrame:
    """The rows of ``docs`` whose language is known; ``declared_col`` becomes the language found."""
    found = identified(docs, text_col, declared_col, address_col, name="__found")
    columns = [F.col("__found.language").alias(c) if c == declared_col else F.col(f"`{c}`") for c in docs.columns]
    return found.where("__found.kept").select(*columns)


@query("op8_language")
def op8_language(spark, folder):
    """Language of every document, with the declared one, the text's own, and whether it is kept."""
    docs = table(spark, folder, "documents")
    return identified(docs, keep=["doc_id", "lang"]).select("doc_id", F.col("lang").alias("declared"), "found.*")


@query("language_of_pages")
def language_of_pages(spark, folder):
    """Language of every page, from its markup's declaration, its address and all its words."""
    from ebbtide.llm.pages import Weights, main_texts

    pages = table(spark, folder, "pages")
    declared = F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    texts = main_texts(pages.withColumn("lang", declared), Weights({}, {}), keep=("page_id", "url", "lang"))
    return identified(texts, address_col="url", keep=["page_id", "url", "lang"]).select("page_id", "url", F.col("lang").alias("declared"), "found.*")
