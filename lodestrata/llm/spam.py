"""Pages stuffed with keywords, tags or links: bagged decision trees, smoothed by host.

Every page gets content and link features. Clear pages are labelled by rules
(weak labels), a bounded sample of them trains bagged trees, and each page's
predicted odds are then shifted by how spammy its host's other pages are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import materialize

#: Most weakly labelled pages of each class used for training, taken by a hash of their key.
TRAIN_ROWS = 4_000
TREES, DEPTH = 15, 6
#: Strength of smoothing: a host's rate counts like so many pages, and moves the log odds by this factor.
PRIOR_PAGES, HOST_FACTOR = 50.0, 0.3
#: Copies of each host's rate, so that one host's many pages are joined by as many tasks.
SALTS = 8

FEATURES = ["link_share", "tag_share", "list_share", "stuffed_share", "top_pairs", "top_word", "distinct", "packed", "ends", "links", "wordy", "line_chars", "bullet_share"]

_URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
_LINK = re.compile(r"!?\[[^\]\n]*\]\((?:https?:|www\.|/)[^)\n]*\)|<a\s[^>\n]*>[^<\n]*</a>(?:<br\s*/?>)?|(?:https?://|www\.)\S+", re.I)
_TAG = re.compile(r"(?<!\w)#[^\s#,;.]+")
#: Words; in scripts written without spaces each character stands for itself.
_TOKEN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af]|[^\W_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af]+")
_END = re.compile(r"[.!?](?=\s|$)|[。！？]")
_REFERENCE = re.compile(r"^\s*\[?\d+[\].]")
#: What stands between the entries of a list within a line.
_BETWEEN = re.compile(r"\s*[·•»|;,、，；]\s*|\s+[-–—/>]\s+")


def _top_pairs(tokens: list[str]) -> float:
    """Share of tokens in the four most frequent repeated pairs of neighbours."""
    if len(tokens) < 12:
        return 0.0
    top = sorted(Counter(zip(tokens, tokens[1:])).values())[-4:]
    return min(1.0, 2 * sum(n for n in top if n > 2) / len(tokens))


def _link_chars(line: str) -> int:
    """Characters of a line that are links; the whole line if little else is in it, nothing in a numbered source."""
    if "http" not in line and "www." not in line and "](" not in line and "href" not in line.lower() or _REFERENCE.match(line):
        return 0
    link = sum(m.end() - m.start() for m in _LINK.finditer(line))
    return len(line) if link and (len(line) - link <= 80 and not _END.search(line[:-1].split("http")[0])) else link


def _is_list(line: str) -> bool:
    """A line of short entries side by side: not a table row, not a contents line, no sentence."""
    if line.lstrip()[:1] in "|" or "...." in line or _END.search(line.rstrip(".…")) or _REFERENCE.match(line):
        return False
    parts = [x for x in _BETWEEN.split(line) if x]
    return len(parts) >= 3 and len(line) / len(parts) <= 48 and not any(x.replace(".", "").replace("%", "").isdigit() for x in parts)


def page_features(text: str) -> tuple[float, ...]:
    """The values of ``FEATURES`` for a text with something in it."""
    n = len(text)
    tokens, link, tag, listed, stuffed, bullets, lines = [], 0, 0, 0, 0, 0, 0
    for block in text.split("\n\n"):
        size, own_link, own_list = len(block), 0, 0
        for line in block.split("\n"):
            if line:
                lines += 1
                own_link += _link_chars(line)
                own_list += len(line) if _is_list(line) else 0
                bullets += len(line) if line[0] in "-*|" else 0
        own_tag = sum(m.end() - m.start() + 1 for m in _TAG.finditer(block)) if "#" in block else 0
        # the lines of a list of contents repeat much and are no bait
        own = _TOKEN.findall((block if "...." not in block else "\n".join(x for x in block.split("\n") if "...." not in x)).lower())
        distinct = len(set(own)) / len(own) if own else 1.0
        repeated = distinct < 0.45 and sum(map(len, own)) > 0.6 * size and (_top_pairs(own) > 0.3 or (len(own) >= 40 and distinct < 0.25))
        if max(own_link, own_tag, own_list) > 0.5 * size or repeated:
            stuffed += size
        link, tag, listed = link + own_link, tag + own_tag, listed + own_list
        tokens += own
    m = max(1, len(tokens))
    counts = Counter(tokens)
    raw = text.encode("utf-8", "replace")
    return (
        link / n, tag / n, listed / n, stuffed / n, _top_pairs(tokens), max(counts.values(), default=0) / m, len(counts) / m, len(zlib.compress(raw, 1)) / len(raw),
        len(_END.findall(text)) * 100 / m, len(_URL.findall(text)) * 100 / m, sum(map(len, tokens)) / n, n / max(1, lines), bullets / n,
    )


def features(pages: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(id, host, *FEATURES) of every page whose text isn't blank; whole texts, no shuffle."""
    kind = pages.schema[key].dataType.simpleString()
    schema = f"id {kind}, host string, " + ", ".join(f"{f} double" for f in FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [page_features(t) for t in batch.column(2).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in zip(*rows))], names=["id", "host", *FEATURES])

    read = pages.select(F.col(key).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("text"))
    return read.where(F.col("text").rlike(r"(?U)\S")).mapInArrow(run, schema)


def weak_label() -> Column:
    """1 for clear spam, 0 for clearly honest pages, null for all others."""
    stuffed, most = F.col("stuffed_share"), F.greatest("link_share", "tag_share", "list_share")
    return F.when((stuffed > 0.7) | (most > 0.7), 1.0).when((stuffed < 0.25) & (most < 0.25) & (F.col("top_pairs") < 0.3), 0.0)


def train(rows: DataFrame):
    """Bagged trees of a bounded sample of weakly labelled rows; None if a class is missing."""
    labelled = rows.withColumn("label", weak_label()).where("label is not null")
    parts = [labelled.where(F.col("label") == v).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(TRAIN_ROWS) for v in (0.0, 1.0)]
    sample = materialize(parts[0].unionByName(parts[1]).select("label", *FEATURES), "spam-sample").coalesce(1)
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(labelCol="label", featuresCol="v", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=True, minInstancesPerNode=3, seed=11, cacheNodeIds=False)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="v").transform(sample))


def score(pages: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(id, host, page_p, host_rate, p): the trees' probability, the host's rate and the smoothed probability.

    Pages without text aren't scored; a null host is a host of its own; without
    clear pages of both kinds the weak labels alone decide. Repeated rows stay.
    """
    rows = materialize(features(pages, key, text, host), "spam-features")
    model = train(rows)
    if model is None:
        scored = rows.select("id", "host", F.coalesce(weak_label(), F.lit(0.0)).alias("page_p"))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="v").transform(rows)).select("id", "host", vector_to_array("probability")[1].alias("page_p"))
    # one aggregate of few rows: hosts, with the rate over all of them for shrinkage
    sums = scored.groupBy("host").agg(F.sum("page_p").alias("s"), F.count(F.lit(1)).alias("n"))
    overall = sums.agg((F.sum("s") / F.sum("n")).alias("rate")).first().rate
    if overall is None:
        return rows.select("id", "host", F.lit(0.0).alias("page_p"), F.lit(0.0).alias("host_rate"), F.lit(0.0).alias("p"))
    rates = sums.select("host", ((F.col("s") + PRIOR_PAGES * overall) / (F.col("n") + PRIOR_PAGES)).alias("host_rate")).withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    logit = lambda c: F.log((F.least(F.greatest(c, F.lit(1e-3)), F.lit(1 - 1e-3))) / (1 - F.least(F.greatest(c, F.lit(1e-3)), F.lit(1 - 1e-3))))
    joined = scored.withColumn("salt", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(SALTS)).cast("int")).join(rates, ["host", "salt"]).drop("salt")
    return joined.withColumn("p", 1 / (1 + F.exp(-(logit(F.col("page_p")) + HOST_FACTOR * (logit(F.col("host_rate")) - logit(F.lit(float(overall))))))))


def found(documents: DataFrame) -> DataFrame:
    """p9: doc_id of the pages that are search bait."""
    return score(documents, "doc_id", "text", "source").where("p > 0.5").select(F.col("id").alias("doc_id")).distinct()
