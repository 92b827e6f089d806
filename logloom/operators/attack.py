"""ATT&CK techniques of events and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import tables as T

TECHNIQUE = "array<struct<id:string,name:string,tactic:string>>"


def techniques_of(event_type: Column, fallback: Column | None = None, mode: str = "both") -> Column:
    """Techniques of a type (of ``fallback`` where it is unknown), of one mode: attacker_infra, victim_server or both."""
    one = lambda t: F.struct(F.lit(t[0]).alias("id"), F.lit(t[1]).alias("name"), F.lit(t[2]).alias("tactic"))
    pairs = [(F.lit(e), F.array(*map(one, found))) for e, found in T.techniques_by_type().items()]
    table = F.create_map(*(x for p in pairs for x in p))
    kind = event_type if fallback is None else F.when(event_type.isin("", "unknown") | event_type.isNull(), fallback).otherwise(event_type)
    found = F.coalesce(F.try_element_at(table, kind), F.array().cast(TECHNIQUE))
    wanted = {"attacker_infra": T.ATTACKER_TACTICS, "victim_server": T.VICTIM_TACTICS}.get(mode)
    return F.filter(found, lambda t: t["tactic"].isin(wanted)) if wanted else found


def enriched(events: DataFrame, mode: str = "both") -> DataFrame:
    out = events.withColumn("mitre_techniques", techniques_of(F.col("event_type"), mode=mode))
    out = out.withColumn("mitre_tactics", F.array_distinct(F.col("mitre_techniques.tactic")))
    return out.withColumn("is_attacker_infra", F.exists("mitre_tactics", lambda t: t.isin(T.ATTACKER_TACTICS)))


def _each(events: DataFrame) -> DataFrame:
    """A row for each technique of each type, with how many events have it: types are counted first, so few rows explode."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(techniques_of(F.col("event_type"))).alias("t")).select("n", "t.*")


def tactic_counts(events: DataFrame) -> DataFrame:
    return _each(events).groupBy("tactic").agg(F.sum("n").alias("n"))


def technique_counts(events: DataFrame) -> DataFrame:
    return _each(events).groupBy("id").agg(F.min("name").alias("name"), F.min("tactic").alias("tactic"), F.sum("n").alias("n"))


def infra_buckets(events: DataFrame) -> DataFrame:
    """Events of each kind of attacker infrastructure; an event may count for several. Empty kinds show 0."""
    counts = [F.count_if(F.col("event_type").isin(types)).alias(b) for b, types in T.INFRA_BUCKETS.items()]
    return events.agg(*counts).unpivot([], list(T.INFRA_BUCKETS), "bucket", "n")


def kill_chain(events: DataFrame) -> DataFrame:
    """The phases of the kill chain in order, and whether any event shows them."""
    seen = tactic_counts(events).withColumnRenamed("tactic", "seen")
    phases = events.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, T.KILL_CHAIN))).alias("phase", "tactic"))
    return phases.join(seen, F.col("tactic") == F.col("seen"), "left").select("phase", "tactic", F.col("seen").isNotNull().alias("detected"), F.col("tactic").isin(T.ATTACKER_TACTICS).alias("is_infra_tactic"))


def kill_chain_rollup(events: DataFrame) -> DataFrame:
    """For each phase of the graph: hits, different techniques, and its intensity against the busiest phase."""
    by = _each(events).groupBy("tactic").agg(F.sum("n").alias("n"), F.countDistinct("id").alias("n_techniques")).withColumnRenamed("tactic", "seen")
    phases = events.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, T.GRAPH_PHASES))).alias("phase", "tactic"))
    out = phases.join(by, F.col("tactic") == F.col("seen"), "left").select("phase", "tactic", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_techniques", F.lit(0)).alias("n_techniques"))
    top = out.agg(F.max("n").alias("top"))
    return out.join(F.broadcast(top)).withColumn("intensity", F.when(F.col("n") > 0, F.greatest(F.lit(0.3), F.col("n") / F.col("top"))).otherwise(0.0)).drop("top")
