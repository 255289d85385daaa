"""Capital needs: what is planned at a facility, how large it is, and what a cost curve says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.functions import status as st

from . import relational as rel

#: Tiers of treatment, the lowest first, and leaves that their group would put elsewhere (fixed values).
TIERS = ("lagoon", "aerated_lagoon", "secondary_mechanical", "advanced")
ADVANCED = ("UV-AOP", "Activated Carbon", "Ion Exchange", "Denitrification Filter", "Nitrification")
SECONDARY = (
    "Trickling Filter", "Rotating Biological Contactor", "Moving Bed Biofilm Reactor",
    "Membrane Aerated Biofilm Reactor", "Unspecified FFR", "Biologically Active Filtration",
)
DISINFECTION, WITH_IT = ("Chlorination", "UV Disinfection"), "Dechlorination"
#: Future flow that counts as an expansion, as a multiple of the current one; the largest plant scored, in MGD.
GROWTH, MOST_MGD = 1.05, 5.0
CURVES = "system string, construction string, place int, low double, high double, form string, a double, b double, basis string, limit_mgd double"


def tiers(taxonomy: DataFrame) -> DataFrame:
    """process, tier (its rank): of leaves that have one."""
    leaf, top = F.col("leaf"), F.col("category")
    tier = (
        F.when(leaf.isin(*ADVANCED) | (top == "Nutrient Removal") | (F.col("grp") == "Membrane Process"), 3)
        .when(leaf.isin(*SECONDARY) | (top == "Activated Sludge"), 2)
        .when(leaf == "Aerated Lagoon", 1)
        .when(top == "Lagoon", 0)
    )
    return taxonomy.select(leaf.alias("process"), tier.alias("tier")).filter("tier IS NOT NULL")


def planned(statuses: DataFrame, key: str) -> DataFrame:
    """key, present, future: arrays over the documents in force. A plain FUTURE goes where another document
    says present; PRESENT_AND_FUTURE stays. Keys without a plan are left out."""
    of = lambda s: F.max(F.col("status") == s)
    rows = statuses.groupBy(key, "process").agg(F.max(st.is_present(F.col("status"))).alias("now"), of("PRESENT_AND_FUTURE").alias("both"), of("FUTURE").alias("then"))
    sets = rows.groupBy(key).agg(
        F.sort_array(F.collect_set(F.when(F.col("now"), F.col("process")))).alias("present"),
        F.sort_array(F.collect_set(F.when(F.col("both") | (F.col("then") & ~F.col("now")), F.col("process")))).alias("future"),
    )
    return sets.filter(F.size("future") > 0)


def curve_table(spark: SparkSession, curves: dict) -> DataFrame:
    """The segments of cost curves as a table: system, construction (or the disinfectant, of add_disinfection),
    place, [low, high] in MGD, form, a, b, basis, limit."""
    rows = []
    for system, by in curves["systems"].items():
        for construction, spec in by.items():
            low = None
            for i, s in enumerate(spec["segments"]):
                rows.append((system, construction, i, low, s["max_mgd"], s["form"], float(s["a"]), float(s["b"]), s.get("basis", ""), float(spec["limit_mgd"])))
                low = s["max_mgd"]
    return spark.createDataFrame([tuple(float(x) if i in (3, 4) and x is not None else x for i, x in enumerate(r)) for r in rows], CURVES)


def scale_of(curves: dict) -> float:
    return curves["cpi_adjustment"] * curves["location_factor"] / curves["national_average_location_factor"]


def construction(present: Column, future: Column, tier_now: Column, tier_then: Column, flow: Column, flow_then: Column) -> Column:
    """The first rule that holds: nothing present, only disinfection planned, a higher tier, a larger flow,
    else rehabilitation."""
    disinfects = F.arrays_overlap(future, F.array(*map(F.lit, DISINFECTION)))
    nothing_else = F.size(F.array_except(future, F.array(*map(F.lit, (*DISINFECTION, WITH_IT))))) == 0
    grows = F.coalesce((flow > 0) & (flow_then > flow * GROWTH), F.lit(False))
    return (
        F.when(F.size(present) == 0, "new")
        .when(disinfects & nothing_else, "add_disinfection")
        .when(F.coalesce(tier_then > tier_now, F.lit(False)), "treatment_upgrade")
        .when(grows, "system_expansion")
        .otherwise("rehabilitation")
    )


def priced(df: DataFrame, curves: DataFrame, mgd: str = "mgd") -> DataFrame:
    """``df`` (system, construction, mgd) with base_cost, basis and within_limit by the first segment that
    reaches the flow: linear a x + b, or power a x^b. Rows without a curve have NULL."""
    of = curves.select(F.col("system").alias("__s"), F.col("construction").alias("__c"), "place", "high", "form", "a", "b", "basis", "limit_mgd")
    x = F.col(mgd)
    cost = F.when(F.col("form") == "linear", F.col("a") * x + F.col("b")).otherwise(F.col("a") * F.pow(x, F.col("b")))
    one = of.groupBy("__s", "__c", "limit_mgd").agg(F.sort_array(F.collect_list(F.struct("place", "high", "form", "a", "b", "basis"))).alias("segments"))
    joined = df.join(rel.small(one), (F.col("system") == F.col("__s")) & (F.col("construction") == F.col("__c")), "left")
    first = F.filter("segments", lambda s: s["high"].isNull() | (x <= s["high"]))
    joined = joined.withColumn("__seg", F.get(first, F.lit(0)))
    for name in ("form", "a", "b", "basis"):
        joined = joined.withColumn(name, F.col(f"__seg.{name}"))
    out = joined.withColumn("base_cost", cost).withColumn("within_limit", x <= F.col("limit_mgd"))
    return out.drop("__s", "__c", "__seg", "segments", "form", "a", "b", "limit_mgd")


def costed(plans: DataFrame, key: str, taxonomy: DataFrame, curves: dict, survey_flow: DataFrame, listed_flow: DataFrame) -> DataFrame:
    """What each plan (``planned`` with survey_id and facility_id) costs: system, construction, flows, cost,
    within_limit, excluded_reason. ``survey_flow``: survey_id, flow, flow_then; ``listed_flow``: facility_id, flow,
    used where the survey has none (then nothing is known of the future)."""
    spark = plans.sparkSession
    tier = rel.small(tiers(taxonomy))
    best = lambda c: plans.select(key, F.explode(c).alias("process")).join(tier, "process").groupBy(key).agg(F.max("tier").alias("tier_of_" + c))
    df = plans.join(best("present"), key, "left").join(best("future"), key, "left").withColumn("tier", F.greatest("tier_of_present", "tier_of_future"))
    df = df.join(survey_flow.select("survey_id", F.col("flow").alias("__a"), F.col("flow_then").alias("__b")), "survey_id", "left")
    df = df.join(listed_flow.select("facility_id", F.col("flow").alias("__listed")), "facility_id", "left")
    known = F.col("__a").isNotNull()
    df = df.withColumn("flow", F.coalesce("__a", "__listed")).withColumn("flow_then", F.when(known, F.col("__b")))
    df = df.withColumn("flow_source", F.when(known, "survey").when(F.col("__listed").isNotNull(), "listed").otherwise(""))
    kind = construction(F.col("present"), F.col("future"), F.col("tier_of_present"), F.col("tier"), F.col("flow"), F.col("flow_then"))
    system = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1)
    df = df.withColumn("construction_type", kind).withColumn("system_type", F.when(F.col("tier").isNotNull(), system))
    df = df.withColumn("disinfectant", F.when(kind == "add_disinfection", F.when(F.array_contains("future", "UV Disinfection"), "uv").otherwise("chlorine")))
    df = df.withColumn("mgd", F.when(F.col("construction_type").isin("new", "system_expansion"), F.col("flow_then")).otherwise(F.col("flow")))
    no_flow = F.coalesce(F.col("mgd") <= 0, F.lit(True))
    reason = F.when(no_flow, "no design flow").when(F.col("system_type").isNull() & (F.col("construction_type") != "add_disinfection"), "unclassified system").otherwise("")
    df = df.withColumn("excluded_reason", reason)
    adds = F.col("construction_type") == "add_disinfection"
    usable = F.col("excluded_reason") == ""
    df = df.withColumn("system", F.when(usable, F.when(adds, "add_disinfection").otherwise(F.col("system_type")))).withColumn("construction", F.when(adds, F.col("disinfectant")).otherwise(F.col("construction_type")))
    out = priced(df, curve_table(spark, curves)).withColumn("cost", F.col("base_cost") * scale_of(curves))
    names = [c for c in plans.columns if c not in ("present", "future")]
    return out.select(
        *names, "system_type", "construction_type", "disinfectant", "flow", "flow_then", "mgd", "flow_source", F.size("future").alias("n_future"),
        F.array_join("future", "; ").alias("future_processes"), "cost", F.when(usable, F.col("within_limit")).alias("within_limit"), "basis", "excluded_reason",
    )


def scored(costs: DataFrame) -> DataFrame:
    """The plans that are scored: with a cost, under the size limit, within their curve's."""
    return costs.filter(F.col("cost").isNotNull() & (F.col("mgd") < MOST_MGD) & F.col("within_limit"))


def by_construction(costs: DataFrame, *keys: str) -> DataFrame:
    """Scored costs per construction type, disinfection shown as new."""
    kind = F.when(F.col("construction_type") == "add_disinfection", "new").otherwise(F.col("construction_type"))
    return scored(costs).groupBy(*keys, kind.alias("construction_type")).agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("facilities"))


def cohort(rows: DataFrame, key: str, snapshot: str, snapshots: Sequence[str]) -> DataFrame:
    """The keys with a row in every one of the snapshots."""
    return rel.in_every(rows.filter(F.col(snapshot).isin(*snapshots)), key, snapshot, len(snapshots))
