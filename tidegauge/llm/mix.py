"""Mixing sources to target weights with soft memberships.

A naive-Bayes classifier, counted over labelled documents, predicts a posterior over the sources (domains) for each
document. Distributed projected-gradient least squares then fits nonnegative rates per document so that the
expected domain token totals meet the targets; the rates are rounded to whole repeats.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.shared import checkpointed
from tidegauge.llm.tokens import buffers, chunks, count_tokens
from tidegauge.llm.words import hash_words

#: Word buckets of the classifier; labelled documents it is counted over at most (on average).
CLASS_BITS, MAX_LABELLED = 12, 50_000
#: Words that a document's evidence counts for at most, and the trust in a document's own label.
EVIDENCE, LABEL_TRUST = 64.0, 0.9
#: Passes with posteriors, passes with the labels themselves, and the residual (share of all tokens) that ends them.
SOFT_PASSES, SHARP_PASSES, TOLERANCE = 12, 20, 1e-5
#: Sources that may be mixed at once: their totals travel to the driver in every pass.
MAX_SOURCES = 1000
#: Documents of a task; documents among which rates are rounded.
DOCS_A_TASK, ROUNDING_GROUP = 200_000, 5000


def canonical_source(column: str = "source"):
    """Source without surrounding blanks, in lower case."""
    return F.lower(F.btrim(column, F.lit(" \t\r\n")))


def mix_targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """``(source, weight, max_repeat)`` of the usable targets, by source; a repeated source keeps its largest values."""
    rows = (
        targets.filter("source is not null and weight >= 0")
        .groupBy(canonical_source().alias("source"))
        .agg(F.max("weight").alias("weight"), F.max(F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0))).alias("max_repeat"))
        .orderBy("source")
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return [(r["source"], r["weight"], r["max_repeat"]) for r in rows]


def word_counts(labelled: DataFrame, n_sources: int) -> np.ndarray:
    """``(n_sources, buckets)`` counts of hashed words over rows ``(k, text)``, added up per task and then over all."""
    size = 1 << CLASS_BITS
    shift = np.uint64(64 - CLASS_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_sources, size), np.int64)
        for b in batches:
            k = b.column("k").to_numpy(zero_copy_only=False)
            data, ends = buffers(b.column("text"))
            for i, j in chunks(data, ends, 1 << 20):
                words, n = hash_words(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                at = np.repeat(k[i:j], n).astype(np.int64) * size + (words >> shift).astype(np.int64)
                total += np.bincount(at, minlength=n_sources * size).reshape(n_sources, size)
        source, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(source.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[source, bucket])], names=["k", "bucket", "n"]
        )

    rows = labelled.mapInArrow(count, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((n_sources, size))
    out[rows["k"], rows["bucket"]] = rows["n"]
    return out


def _memberships(log_odds: np.ndarray, prior: np.ndarray):
    """Map batches ``(doc_id, k, text)`` to ``(doc_id, k, tokens, q)``; ``k`` is the document's own source, ``q`` its posterior."""
    n_sources = len(prior)
    shift = np.uint64(64 - CLASS_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            data, ends = buffers(texts)
            k = b.column("k").to_numpy(zero_copy_only=False).astype(np.int64)
            logit = np.zeros((len(k), n_sources))
            for i, j in chunks(data, ends, 1 << 20):
                words, n = hash_words(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                if not len(words):
                    continue
                own = np.repeat(np.arange(j - i), n)
                bucket = (words >> shift).astype(np.int64)
                for s in range(n_sources):
                    logit[i:j, s] = np.bincount(own, log_odds[s, bucket], j - i) / (1 + n / EVIDENCE)
            logit += np.log(prior)
            q = np.exp(logit - logit.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            label = np.full((len(k), n_sources), (1 - LABEL_TRUST) / n_sources)
            label[np.arange(len(k)), k] += LABEL_TRUST
            q *= label
            q /= q.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k"), pa.array(count_tokens(texts)),
                 pa.ListArray.from_arrays(np.arange(0, q.size + 1, n_sources, dtype=np.int32), pa.array(q.ravel().astype(np.float32)))],
                names=["doc_id", "k", "tokens", "q"],
            )

    return run


def memberships(documents: DataFrame, sources: Sequence[str], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, k, tokens, q)`` of the documents whose canonical source is among ``sources``, kept in the shared folder.

    ``k`` is the index of the document's source, ``q`` its posterior over the sources. The classifier is counted over
    about ``max_labelled`` labelled documents, drawn by the hash of their id. Repeated ids count once.
    """
    index = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))])
    rows = documents.select("doc_id", F.try_element_at(index, F.coalesce(canonical_source(), F.lit(""))).alias("k"), "text").filter(
        F.col("k").isNotNull() & F.col("doc_id").isNotNull()
    )
    n = [0] * len(sources)
    for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r["k"]] = r["n"]
    total = sum(n)
    share = min(1.0, max_labelled / max(1, total))
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000)).select("k", "text")
    counts = word_counts(drawn, len(sources)) + 0.5
    log_p = np.log(counts / counts.sum(1, keepdims=True))
    prior = (np.array(n) + 1.0) / (total + len(sources))
    scored = rows.mapInArrow(_memberships(log_p - log_p.mean(0), prior), "doc_id bigint, k int, tokens bigint, q array<float>")
    once = scored.groupBy("doc_id").agg(F.min_by(F.struct("k", "tokens", "q"), F.struct("k", "tokens")).alias("x"))
    return checkpointed(once.select("doc_id", "x.*").repartition(max(1, total // DOCS_A_TASK)))


def _rates(k: np.ndarray, q: np.ndarray, most: np.ndarray, steps: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """Rates after the projected steps ``(sharpness, pull per source)``, from rate 1 within the cap."""
    top = most[k].astype(float)
    rate = np.minimum(1.0, top)
    for sharp, pull in steps:
        toward = pull[k] if sharp else q @ pull
        rate = np.clip(rate - toward, 0, top)
    return rate


def fit_rates(members: DataFrame, target: np.ndarray, most: np.ndarray) -> tuple[list, np.ndarray]:
    """Projected-gradient steps that bring the domain totals to ``target`` (tokens), and the totals they end with.

    Minimises the squared residuals per domain, each over the domain's own tokens, for rates in ``[0, most]``. In that
    scaling a document's step depends on its posterior only, so the few numbers of each step define all rates and
    no state is kept between passes. The first passes use posteriors, the others the labels themselves, so that the
    totals by label are met as well.
    """
    n_sources = len(target)
    steps: list[tuple[float, np.ndarray]] = []
    scale = max(1.0, float(target.sum()))

    def totals(sharp: bool) -> np.ndarray:
        fixed = list(steps)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, n_sources))
            for b in batches:
                k = b.column("k").to_numpy(zero_copy_only=False)
                q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(len(k), n_sources).astype(float)
                tokens = b.column("tokens").to_numpy(zero_copy_only=False)
                used = _rates(k, q, most, fixed) * tokens
                one = np.zeros_like(q)
                one[np.arange(len(k)), k] = 1
                out += np.stack([used @ (one if sharp else q), tokens @ (one if sharp else q)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n_sources, dtype=np.int32)), pa.array(out[0]), pa.array(out[1])], names=["k", "used", "all"]
            )

        rows = members.mapInArrow(run, "k int, used double, all double").groupBy("k").agg(F.sum("used").alias("used"), F.sum("all").alias("all"))
        out = np.zeros((2, n_sources))
        for r in rows.collect():
            out[:, r["k"]] = r["used"], r["all"]
        return out

    used = np.zeros(n_sources)
    for sharp, passes in ((False, SOFT_PASSES), (True, SHARP_PASSES)):
        before = None
        for _ in range(passes):
            used, own = totals(sharp)
            residual = used - target
            # a source whose documents are all at their cap can't come nearer
            moved = np.inf if before is None else np.abs(used - before).max()
            if np.abs(residual).max() < TOLERANCE * scale or moved < TOLERANCE * scale:
                break
            before = used
            steps.append((float(sharp), residual / np.maximum(own, 1.0)))
    return steps, used


def mix_documents(documents: DataFrame, targets: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, list[tuple[str, float, int]]]:
    """Selection ``(doc_id, k, tokens, rate, repeats)`` of every document of a target source, and the targets.

    The total aimed at is that of all documents of the target sources. ``repeats`` is the rate rounded to a whole number
    in groups of bounded size that carry what is owed from document to document, so that a group's total is off by half of
    a short document; it never exceeds ``max_repeat``, and may be 0. Null and empty texts have no tokens.
    Without targets or documents the selection is empty.
    """
    wanted = mix_targets(targets)
    members = memberships(documents, [s for s, _, _ in wanted], max_labelled) if wanted else None
    schema = "doc_id bigint, k int, tokens bigint, rate double"
    if members is None:
        return documents.sparkSession.createDataFrame([], schema + ", repeats int"), wanted
    weight = np.array([w for _, w, _ in wanted])
    most = np.array([m for _, _, m in wanted])
    total = members.agg(F.sum("tokens")).first()[0] or 0
    n_docs = members.count()
    steps, _ = fit_rates(members, weight * total, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("k").to_numpy(zero_copy_only=False)
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(len(k), len(most)).astype(float)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k"), b.column("tokens"), pa.array(_rates(k, q, most, steps))], names=["doc_id", "k", "tokens", "rate"]
            )

    rated = members.mapInArrow(run, schema)
    group = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(max(1, n_docs // ROUNDING_GROUP))).alias("g")
    return rated.groupBy("k", group).applyInPandas(lambda pdf: _rounded(pdf, most), schema + ", repeats int"), wanted


def _rounded(pdf: pd.DataFrame, most: np.ndarray) -> pd.DataFrame:
    """Whole repeats of one group's documents: from the longest to the shortest, each takes one more repeat if that brings
    the tokens given so far nearer to those due, so the group ends within half of one of its short documents."""
    pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True])
    top = int(most[pdf["k"].iloc[0]])
    owed, out = 0.0, []
    for rate, tokens in zip(pdf["rate"].tolist(), pdf["tokens"].tolist(), strict=True):
        n = min(int(rate), top)
        owed += (rate - n) * tokens
        if n < top and rate > n and owed >= tokens / 2:
            n += 1
            owed -= tokens
        out.append(n)
    return pdf.assign(repeats=np.array(out, np.int32))


def mix_report(selection: DataFrame, wanted: list[tuple[str, float, int]]) -> DataFrame:
    """Shares per source: ``(source, weight, max_repeat, tokens, n_docs, selected_tokens, n_selected, share, is_short)``.

    ``is_short``: even at ``max_repeat`` the source's tokens stay below its weight of the tokens of all
    target sources. ``share`` is of the selected tokens (null if there are none).
    """
    spark = selection.sparkSession
    table = spark.createDataFrame([(i, s, w, m) for i, (s, w, m) in enumerate(wanted)], "k int, source string, weight double, max_repeat int")
    sums = selection.groupBy("k").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("selected_tokens"),
        F.sum("repeats").alias("n_selected"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    joined = table.join(sums, "k", "left").select(
        "source", "weight", "max_repeat", zero("tokens"), zero("n_docs"), zero("selected_tokens"), zero("n_selected")
    )
    # one row per target: at most MAX_SOURCES rows in the window
    everything = Window.partitionBy(F.lit(0))
    return joined.withColumn("share", F.try_divide(F.col("selected_tokens"), F.sum("selected_tokens").over(everything))).withColumn(
        "is_short", F.col("tokens") * F.col("max_repeat") < F.col("weight") * F.sum("tokens").over(everything)
    )


def short_sources(report: DataFrame) -> DataFrame:
    """``source`` of the targets that can't reach their weight."""
    return report.filter("is_short").select("source")
