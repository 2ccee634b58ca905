"""Knowledge-base bundle: techniques, tactics, detection chain, template content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Description classes.
OUTCOME_MARKS = ("goal", "gained through", "provide the opportunity")
RELATION_MARKS = ("lifecycle", "paired with")
TACTIC_NAMES = (
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation",
    "Defense Evasion", "Stealth", "Defense Impairment", "Credential Access", "Discovery", "Lateral Movement",
    "Collection", "Command and Control", "Exfiltration", "Impact",
)

OBJECT_SCHEMA = (
    "struct<id:string,type:string,name:string,description:string,x_mitre_shortname:string,"
    "x_mitre_is_subtechnique:boolean,x_mitre_deprecated:boolean,revoked:boolean,"
    "external_references:array<struct<source_name:string,external_id:string>>,"
    "kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,"
    "relationship_type:string,source_ref:string,target_ref:string,x_mitre_analytic_refs:array<string>,"
    "x_mitre_platforms:array<string>>"
)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """One row per object, ``pos`` is its place in the bundle."""
    docs = spark.read.text(path, wholetext=True)
    return parse_bundle(docs)


def parse_bundle(docs: DataFrame) -> DataFrame:
    j = F.from_json("value", f"struct<objects:array<{OBJECT_SCHEMA}>>")
    return docs.select(F.posexplode(j["objects"]).alias("pos", "o")).select(F.col("pos").cast("long").alias("pos"), "o.*")


def external_id() -> Column:
    refs = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    return F.get(refs, F.lit(0))["external_id"]


def techniques(objects: DataFrame) -> DataFrame:
    return objects.filter("type = 'attack-pattern'").withColumn("tid", external_id()).filter("tid is not null")


def technique_tactics(objects: DataFrame) -> DataFrame:
    """(tid, tactic) of the kill-chain phases."""
    phases = F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack")
    return techniques(objects).select("tid", F.explode(phases).alias("p")).select("tid", F.col("p.phase_name").alias("tactic"))


def tactics_with_fallback(wanted: DataFrame, matrix: DataFrame) -> DataFrame:
    """(tid, tactic): tactics of the technique, or of its parent where the matrix has no such id."""
    ids = matrix.select("tid").distinct().withColumn("_own", F.lit(1))
    w = wanted.select("tid").distinct().join(ids, "tid", "left")
    via = w.withColumn("via", F.when(F.col("_own").isNotNull(), F.col("tid")).otherwise(F.substring_index("tid", ".", 1)))
    m = matrix.select(F.col("tid").alias("via"), "tactic").distinct()
    return via.join(m, "via").select("tid", "tactic")


def placements(folders: DataFrame, matrix: DataFrame) -> DataFrame:
    """(tactic, n): how many technique folders each tactic gets. ``folders``: folder, tid."""
    t = tactics_with_fallback(folders, matrix)
    return (
        folders.join(t, "tid")
        .withColumn("tactic", F.replace("tactic", F.lit("-"), F.lit("_")))
        .groupBy("tactic")
        .agg(F.countDistinct("folder").alias("n_techniques"))
    )


def platform_analytics(objects: DataFrame, platform: str = "Linux") -> DataFrame:
    """(technique_ref, pos, description) along technique <- detects - strategy -> analytics, for
    analytics of the platform; ``pos`` orders a technique's descriptions as the bundle does."""
    rel = objects.filter("type = 'relationship' and relationship_type = 'detects'").select(
        F.col("pos").alias("rel_pos"), F.col("source_ref").alias("id"), F.col("target_ref").alias("technique_ref")
    )
    strategies = objects.select("id", F.posexplode("x_mitre_analytic_refs").alias("ref_pos", "aref"))
    analytics = objects.filter(F.array_contains("x_mitre_platforms", platform)).select(
        F.col("id").alias("aref"), F.trim("description").alias("description")
    )
    return (
        rel.join(strategies, "id")
        .join(analytics, "aref")
        .filter(F.col("description") != "")
        .select("technique_ref", F.struct("rel_pos", "ref_pos").alias("pos"), "description")
    )


def _first_distinct(rows: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    return rows.groupBy(*keys, text).agg(F.min(F.struct(*order)).alias("pos"))


def tactic_templates(objects: DataFrame, platform: str = "Linux") -> DataFrame:
    """(tactic_id, tactic, tid, technique, n, description): current top-level techniques of each
    tactic with their distinct platform descriptions in first order (null without any)."""
    tactics = objects.filter("type = 'x-mitre-tactic'").select(
        external_id().alias("tactic_id"), F.col("name").alias("tactic"), F.col("x_mitre_shortname").alias("phase")
    )
    current = ~(
        F.coalesce("x_mitre_is_subtechnique", F.lit(False))
        | F.coalesce("x_mitre_deprecated", F.lit(False))
        | F.coalesce("revoked", F.lit(False))
    )
    tech = (
        objects.filter("type = 'attack-pattern'").filter(current)
        .select("id", external_id().alias("tid"), F.col("name").alias("technique"), F.explode("kill_chain_phases").alias("p"))
        .select("id", "tid", "technique", F.col("p.phase_name").alias("phase"))
        .distinct()
    )
    desc = _first_distinct(platform_analytics(objects, platform), ["technique_ref"], "description", ["pos"])
    return (
        tactics.join(tech, "phase")
        .join(desc, F.col("id") == F.col("technique_ref"), "left")
        .select("tactic_id", "tactic", "tid", "technique", "pos", "description")
    )


def dataset_templates(folders: DataFrame, objects: DataFrame, base_only: bool = False, platform: str = "Linux") -> DataFrame:
    """(tactic, pos, description): distinct descriptions of the techniques a dataset has per tactic,
    in folder order; ``base_only`` drops the sub-technique part. ``folders``: tactic, folder."""
    base, sub = F.substring_index("folder", "-", 1), F.expr("substring(folder, instr(folder, '-') + 1, length(folder))")
    tid = base if base_only else F.when(sub == "000", base).otherwise(F.concat(base, F.lit("."), sub))
    ids = folders.withColumn("tid", tid).groupBy("tactic", "tid").agg(F.min("folder").alias("folder"))
    # the last object with an id stands for it
    tech = techniques(objects).groupBy("tid").agg(F.max_by("id", "pos").alias("technique_ref"))
    rows = ids.join(tech, "tid").join(platform_analytics(objects, platform), "technique_ref")
    return _first_distinct(rows, ["tactic"], "description", ["folder", "pos"])


def technique_gaps(folders_tid: DataFrame, objects: DataFrame, platform: str = "Linux") -> DataFrame:
    """Per wanted technique: whether the bundle has it and how many platform descriptions it has."""
    tech = techniques(objects).groupBy("tid").agg(F.max_by("id", "pos").alias("technique_ref"))
    n = platform_analytics(objects, platform).groupBy("technique_ref").agg(F.count(F.lit(1)).alias("n"))
    return (
        folders_tid.select("tid").distinct().join(tech, "tid", "left").join(n, "technique_ref", "left")
        .select("tid", F.col("technique_ref").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).alias("n_descriptions"))
    )


def describe_tactic(text: Column, tactic_name: Column) -> Column:
    """array<struct(pos, part, sentence)> of a tactic description: bullets joined by commas, first
    sentence the objective, the rest outcome, relationship or technique use."""
    raw = F.regexp_replace(F.trim(text), r"(\*\s+[^\n*]+?)(\n)(?!\s*\*)", "$1.$2")
    raw = F.regexp_replace(raw, r"\n\s*\*\s+", ", ")
    raw = F.trim(F.regexp_replace(F.regexp_replace(raw, r"\n", " "), r"\s+", " "))
    parts = F.filter(F.transform(F.split(raw, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")

    def any_of(low: Column, marks) -> Column:
        hit = low.contains(marks[0])
        for m in marks[1:]:
            hit = hit | low.contains(m)
        return hit

    def related(low: Column) -> Column:
        hit = any_of(low, RELATION_MARKS)
        for name in TACTIC_NAMES:
            other = F.lower(tactic_name) != name.lower()
            hit = hit | (other & low.rlike(rf"\b{name.lower()}\s+(techniques|tactic|phase)"))
        return hit

    return F.transform(
        parts,
        lambda s, i: F.struct(
            i.alias("pos"),
            F.when(i == 0, "objective")
            .when(any_of(F.lower(s), OUTCOME_MARKS), "outcome")
            .when(related(F.lower(s)), "relationship")
            .otherwise("technique use")
            .alias("part"),
            s.alias("sentence"),
        ),
    )
