"""Features of events, an isolation forest over them, and explanations of its scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import tables as T
from logloom.functions.classify import is_private
from logloom.operators.normalize import field
from logloom.sources.stored import quantile, stored

FEATURES = ["hour", "day_of_week", "is_off_hours", "event_type_score", "message_length", "suspicious_keyword_count", "has_external_ip", "file_size_log"]


def type_score(event_type: Column) -> Column:
    scores = F.create_map(*(F.lit(x) for kv in T.TYPE_SCORES.items() for x in kv))
    return F.coalesce(F.try_element_at(scores, event_type), F.lit(1))


def keywords_in(message: Column) -> Column:
    return F.filter(F.array(*(F.lit(k) for k in T.KEYWORDS)), lambda k: message.contains(k))


def features(events: DataFrame) -> DataFrame:
    """Adds the eight features (as doubles) to events with ts, event_type, description, src_ip, size."""
    m = F.lower(F.coalesce(F.col("description"), F.lit("")))
    off = (F.hour("ts") >= 22) | (F.hour("ts") < 6)
    ips = F.regexp_extract_all(m, F.lit(T.IPV4), F.lit(0))
    src_ip = field(events, "src_ip")
    external = F.when(src_ip.isNotNull(), ~is_private(src_ip)).otherwise(F.exists(ips, lambda ip: ~is_private(ip)))
    size = field(events, "size").try_cast("double")
    # an event without a time has no more features than the type score 1
    values = {
        "hour": F.hour("ts"), "day_of_week": F.weekday("ts"), "is_off_hours": off.cast("int"), "event_type_score": type_score(F.col("event_type")),
        "message_length": F.least(F.length(m) / F.lit(200.0), F.lit(5.0)), "suspicious_keyword_count": F.size(keywords_in(m)),
        "has_external_ip": F.coalesce(external, F.lit(False)).cast("int"), "file_size_log": F.when(size > 0, F.log10(size)).otherwise(0.0),
    }
    blank = {"event_type_score": 1.0}
    return events.withColumns({k: F.when(F.col("ts").isNull(), F.lit(blank.get(k, 0.0))).otherwise(v.cast("double")) for k, v in values.items()})


def scaling(rows: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each feature; a deviation of 0 counts as 1."""
    got = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in FEATURES), *(F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES)).first()
    return [got[f"m_{c}"] or 0.0 for c in FEATURES], [got[f"s_{c}"] or 1.0 for c in FEATURES]


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Isolation forest (Liu, Ting and Zhou, 2008): flat arrays of all trees' nodes."""

    def __init__(self, sample: np.ndarray, trees: int = 100, size: int = 256, seed: int = 42):
        self.size = min(size, len(sample))
        depth = int(np.ceil(np.log2(max(self.size, 2))))
        nodes: list[tuple[int, float, int, int, float]] = []  # feature, split, left, right, depth at a leaf
        self.roots = []
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            own = sample[rng.permutation(len(sample))[: self.size]]
            self.roots.append(self._grow(own, 0, depth, rng, nodes))
        self.nodes = [np.array(x) for x in zip(*nodes, strict=True)]
        self.depth = depth

    def _grow(self, x: np.ndarray, at: int, depth: int, rng: np.random.Generator, nodes: list) -> int:
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else np.zeros(0, int)
        me = len(nodes)
        nodes.append((-1, 0.0, me, me, at + average_path(len(x))))
        if at < depth and len(spread):
            f = int(rng.choice(spread))
            split = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            left = x[:, f] < split
            if left.any() and not left.all():
                a = self._grow(x[left], at + 1, depth, rng, nodes)
                b = self._grow(x[~left], at + 1, depth, rng, nodes)
                nodes[me] = (f, split, a, b, 0.0)
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2 ** (-mean depth / average depth): the lower, the easier to isolate."""
        feature, split, left, right, height = self.nodes
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth + 1):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[np.arange(len(x)), f] < split[at], left[at], right[at]))
            total += height[at]
        return -(2.0 ** (-total / len(self.roots) / max(average_path(self.size), 1e-9)))


def isolation_scores(rows: DataFrame, key: str = "event_key", contamination: float = 0.1, trees: int = 100, size: int = 256, seed: int = 42) -> DataFrame:
    """Adds raw_score, anomaly_score (0 to 1, 1 the most anomalous) and is_anomaly to rows with features.

    Trees grow from the rows with the least hashes of ``key``, trees x size at most, so the forest doesn't depend on how rows are
    partitioned. Rows whose score is below the exact ``contamination`` quantile are anomalies; ties at it aren't. Keys and features
    are written once, for scaling, sample and quantile; only the features of a row go through Python. Empty rows stay so.
    """
    narrow = stored(rows.select(F.col(key).alias("key"), *FEATURES), "features")
    mean, scale = scaling(narrow)
    got = narrow.withColumn("h", F.xxhash64("key", F.lit(seed))).orderBy("h", "key", *FEATURES).limit(trees * size).collect()
    if not got:
        return rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("raw_score", "double"), ("anomaly_score", "double"), ("is_anomaly", "boolean"))))
    sample = (np.array([[r[c] for c in FEATURES] for r in got], float) - mean) / scale
    forest = rows.sparkSession.sparkContext.broadcast(Forest(sample, trees, size, seed))

    @F.arrow_udf("double")
    def score(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1)
        return pa.array(forest.value.score((x - mean) / scale))

    raw = stored(narrow.select(score(*FEATURES).alias("raw_score")), "scores")
    low, high = raw.agg(F.min("raw_score"), F.max("raw_score")).first()
    cut = quantile(raw, "raw_score", contamination)
    scored = rows.withColumn("raw_score", score(*FEATURES))
    return scored.withColumn("anomaly_score", inverted(F.col("raw_score"), low, high)).withColumn("is_anomaly", F.col("raw_score") < F.lit(cut))


def inverted(score: Column, low: float, high: float) -> Column:
    """Scores from 1 (least) to 0 (greatest); 0 where all are equal."""
    return (F.lit(high) - score) / F.lit(high - low) if high > low else F.lit(0.0)


def min_max(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``column`` inverted and scaled to 0 ... 1, by a one-row aggregate."""
    ends = rows.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    spread = F.col("__hi") - F.col("__lo")
    return rows.join(F.broadcast(ends)).withColumn(out, F.when(spread > 0, (F.col("__hi") - F.col(column)) / spread).otherwise(0.0)).drop("__lo", "__hi")


def explanation(score_column: str = "event_type") -> Column:
    """Reasons why an event stands out, in a fixed order, joined by ' | '."""
    m = F.lower(F.coalesce(F.col("description"), F.lit("")))
    kind, found = type_score(F.col(score_column)), F.slice(keywords_in(m), 1, 3)
    reasons = F.concat_ws(
        " | ",
        F.when((F.hour("ts") >= 22) | (F.hour("ts") < 6), F.format_string("off hours (%02d:00)", F.hour("ts"))),
        F.when(kind >= 7, F.concat(F.lit("highly suspicious type: "), F.col("event_type"))).when(kind >= 5, F.concat(F.lit("suspicious type: "), F.col("event_type"))),
        F.when(F.size(found) > 0, F.concat(F.lit("keywords: "), F.array_join(found, ", "))),
        F.when(F.col("src_ip").isNotNull() & ~is_private(F.col("src_ip")), F.concat(F.lit("external address: "), F.col("src_ip"))),
        F.when(F.col("size").try_cast("double") > 100 * 1024 * 1024, F.lit("large file")),
        F.when(F.coalesce(F.col("path"), F.lit("")).rlike("^/(tmp|var/tmp|dev/shm)/"), F.lit("temporary path")),
    )
    return F.coalesce(F.nullif(reasons, F.lit("")), F.lit("statistical deviation"))
