"""Term counts and keywords per cluster."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc import rules
from voc.functions.text import kept_tokens, word_list
from voc.operators.clusters import first_k
from voc.storage import materialize

CHUNK_WORDS = 2 << 20   # words whose terms a task counts at once
SENT_ROWS = 100_000


def top_keywords(df: DataFrame, stop_words: Iterable[str], k: int = rules.TOP_KEYWORDS) -> DataFrame:
    """The k most frequent words of each cluster with their place; equal counts in alphabetical order."""
    words = df.select("sub_domain", F.explode(kept_tokens("cleaned_text", stop_words)).alias("term"))
    counts = words.groupBy("sub_domain", "term").agg(F.count("*").alias("n"))
    return first_k(counts, "sub_domain", k, F.desc("n"), "term")


def keyword_lists(top: DataFrame, clusters: DataFrame) -> DataFrame:
    """``sub_domain, keywords``; a cluster without any word gets the default list. At most k terms per cluster."""
    lists = top.groupBy("sub_domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]).alias("found")
    )
    default = word_list(rules.EMPTY_KEYWORDS)
    return (
        clusters.select("sub_domain")
        .join(lists, "sub_domain", "left")
        .select("sub_domain", F.coalesce("found", default).alias("keywords"))
    )


def fallback_keywords(clusters: DataFrame) -> DataFrame:
    """The fixed list every cluster gets when its rows were grouped by k-means instead of topics."""
    return clusters.select("sub_domain", word_list(rules.FALLBACK_KEYWORDS).alias("keywords"))


def _counted(texts: pa.Array, clusters: pa.Array | None) -> pa.RecordBatch:
    """``term, tf, df`` of words and neighbour pairs in lists of words; with clusters ``cluster, term, tf``.

    A term is a number made of its two words' numbers, and one sort by term and text gives both counts.
    """
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = texts.flatten().dictionary_encode()
    word, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    if clusters is None:
        part, names = np.arange(len(sizes)), None
    else:
        clusters = clusters.dictionary_encode()
        part, names = clusters.indices.to_numpy(zero_copy_only=False).astype(np.int64), clusters.dictionary
    part, parts, base = np.repeat(part, sizes), max(1, len(sizes) if names is None else len(names)), len(words) + 1
    inner = np.ones(len(word), bool)   # words with a neighbour behind them
    inner[np.cumsum(sizes)[sizes > 0] - 1] = False
    inner = np.flatnonzero(inner)
    terms = np.concatenate([word * base, word[inner] * base + word[inner + 1] + 1])
    part, distinct = np.concatenate([part, part[inner]]), None
    if base * base * parts >= 1 << 63:
        distinct, terms = np.unique(terms, return_inverse=True)
    keys = np.sort(terms * parts + part)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    tf, terms, part = np.diff(np.append(at, len(keys))), keys[at] // parts, keys[at] % parts
    columns = {}
    if names is None:
        at = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        columns = {"tf": np.add.reduceat(tf, at) if len(at) else tf, "df": np.diff(np.append(at, len(terms)))}
        terms = terms[at]
    else:
        columns = {"tf": tf}
    terms = terms if distinct is None else distinct[terms]
    first, second = terms // base, terms % base
    pair = words.take(pa.array(np.maximum(second - 1, 0)))
    first = words.take(pa.array(first))
    texts = pc.if_else(pa.array(second > 0), pc.binary_join_element_wise(first, pair, " "), first)
    columns = {"term": texts} | {k: pa.array(v, pa.int64()) for k, v in columns.items()}
    return pa.RecordBatch.from_pydict(columns if names is None else {"cluster": names.take(pa.array(part))} | columns)


def _terms(df: DataFrame, stop_words: Iterable[str], clusters: Iterable[str] = ()) -> DataFrame:
    """Rows ``term, tf, df`` whose sums per term are its occurrences and the texts that hold it.

    With the names of clusters, rows ``cluster, term, tf`` with the place of the name. A task counts the terms of about
    ``CHUNK_WORDS`` words at once, so a term leaves it as one row a chunk, not as one or two rows for each place.
    """
    grouped = bool(clusters)
    if grouped:
        df = df.withColumn("cluster", (F.array_position(word_list(clusters), F.col("sub_domain")) - 1).cast("int")).where("cluster >= 0")
    rows = df.select(kept_tokens("cleaned_text", stop_words).alias("words"), *["cluster"] * grouped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            found = _counted(*(pa.concat_arrays([b.column(i) for b in held]) if i <= grouped else None for i in range(2)))
            for low in range(0, found.num_rows, SENT_ROWS):
                yield found.slice(low, SENT_ROWS)

        for batch in batches:
            held.append(batch)
            size += len(batch.column(0).flatten())
            if size >= CHUNK_WORDS:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    return rows.mapInArrow(run, "cluster int, term string, tf bigint" if grouped else "term string, tf bigint, df bigint")


def _side_by_side(rows: DataFrame, clusters: int, least: int) -> DataFrame:
    """``term, c0, c1, ...``: the counts in all clusters, of terms that are in ``least`` clusters at least.

    A partition's rows come sorted by term, so a task holds one batch at a time. A hash aggregate with a sum for each
    cluster would hold and shuffle all of them for every term, most of which are in one cluster only.
    """
    names = ["term", *(f"c{i}" for i in range(clusters))]

    def found(terms: pa.Array, at: np.ndarray, tf: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(heads, len(at)))
        some = sizes >= least   # others have too few rows to be in so many clusters
        rows, heads = np.repeat(some, sizes), heads[some]
        counts = np.zeros((len(heads), clusters), np.int64)
        np.add.at(counts, (np.repeat(np.arange(len(heads)), sizes[some]), at[rows]), tf[rows])
        kept = np.flatnonzero((counts > 0).sum(axis=1) >= least)
        return pa.RecordBatch.from_arrays([terms.take(pa.array(heads[kept])), *(pa.array(c) for c in counts[kept].T)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None   # the last term so far, which may go on: at most a row for each cluster
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, at, tf = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if rest:
                terms, at, tf = pa.concat_arrays([rest[0], terms]), np.append(rest[1], at), np.append(rest[2], tf)
            new = pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.append(True, new))
            last = heads[-1]
            yield found(terms, at[:last], tf[:last], heads[:-1])
            total = np.zeros(clusters, np.int64)
            np.add.at(total, at[last:], tf[last:])
            there = np.flatnonzero(total)
            rest = terms.slice(last, 1).take(pa.array(np.zeros(len(there), int))), there, total[there]
        if rest:
            yield found(*rest, np.zeros(1, int))

    ordered = rows.select("term", "cluster", "tf").repartition("term").sortWithinPartitions("term")
    return ordered.mapInArrow(run, "term string, " + ", ".join(f"{c} bigint" for c in names[1:]))


def term_counts(df: DataFrame, stop_words: Iterable[str], min_df: int = 2) -> DataFrame:
    """Words and neighbour pairs with occurrences ``tf`` and texts ``df``, seen in at least ``min_df`` texts."""
    counts = _terms(df, stop_words).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    return counts.where(F.col("df") >= min_df)


def topic_words(df: DataFrame, stop_words: Iterable[str], k: int = rules.TOP_KEYWORDS, min_df: int = 2) -> DataFrame:
    """Class-based TF-IDF: share of a term in its cluster times ln(1 + mean cluster size / term total).

    Every cluster counts as one text: ``min_df`` is the number of clusters that hold a term.

    Counts of all clusters sit side by side in one row per term, so the term total needs no second shuffle. The terms of
    enough clusters are written once: sizes and scores are taken from them.
    """
    names = rules.DOMAIN_NAMES
    by_term = materialize(_side_by_side(_terms(df, stop_words, names), len(names), min_df), "topic_words")
    cols = [F.col(f"c{i}") for i in range(len(names))]
    sizes = by_term.agg(F.array(*[F.sum(c) for c in cols]).alias("sizes"))
    mean = F.expr("int(aggregate(sizes, 0D, (a, x) -> a + x) / greatest(size(filter(sizes, x -> x > 0)), 1))")
    facts = sizes.select(F.struct("sizes", mean.alias("mean")).alias("facts")).scalar()
    per_cluster = by_term.withColumn("facts", facts).select(
        "term",
        sum(cols[1:], cols[0]).alias("f"),
        F.col("facts.mean").alias("mean"),
        F.inline(F.filter(
            F.array(*[
                F.struct(F.lit(d).alias("sub_domain"), cols[i].alias("tf"), F.col("facts.sizes")[i].alias("size"))
                for i, d in enumerate(names)
            ]),
            lambda s: s["tf"] > 0,
        )),
    )
    scored = per_cluster.withColumn("score", F.col("tf") / F.col("size") * F.log1p(F.col("mean") / F.col("f")))
    return first_k(scored, "sub_domain", k, F.desc("score"), "term").select("sub_domain", "place", "term", "tf", "score")
