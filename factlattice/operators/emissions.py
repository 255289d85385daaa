"""Emissions of facilities from their treatment trains: codes, trains by rules, fallback, factors, totals.

A facility's trains are rows (facility, train); factors a table (train, gas, factor); what a train requires
is configuration: (train, code) pairs. Facilities' codes are rows (facility, code).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlattice.functions import numbers as nb
from factlattice.functions import status as st

from . import relational as rel

#: Cubic metres in a million gallons; kg a day to kt a year; gases by scope (fixed values).
M3_PER_MG, KT_PER_YEAR = 3785.412, 365 / 1e6
SCOPE_1, SCOPE_2, SCOPE_3 = ("CH4", "N2O", "NC_CO2", "NG_comb", "solids"), ("elec",), ("NG_up",)
LAGOON_TRAINS = ("LAGOON_AER", "LAGOON_ANAER", "LAGOON_FAC", "LAGOON_UNCATEGORIZED")
#: Codes that nitrify, those that fallbacks ask for, flags that follow from codes, and what secondary treatment clears.
NITRIFYING = ("NIT", "AS_BNR_N", "AS_BNR_P")
KEY_CODES = ("AS_BNR_P", "AS_BNR_N", "AS-PUREO", "MBR-BNR", "TF_ALL", "MHI", "FBI", "LIME", "NIT", "BASIC_AS", "AND", "AED", "PRIMARY")
SECONDARY = ("AS", "AS-A2O", "AS-BDENIT", "AS-EA", "AS-OD", "AS-P", "AS-PUREO", "AS-SA", "AS-SBR", "TF", "TF-BF", "TF-RBC", "MBR-BNR")
LAGOONS = ("LAGOON", "LAGOON_AER", "LAGOON_ANAER", "LAGOON_FAC", "STBL_POND")
#: Flow bins in MGD, right-open (fixed values).
EDGES, BINS = (0, 2, 4, 7, 16, 46, 100, float("inf")), ("<2", "2-4", "4-7", "7-16", "16-46", "46-100", "≥100")
#: kg CO2e per MWh of upstream fuel chains: grams per MJ (fixed values) times 3.6, and the fuels' columns.
UPSTREAM = {"natural_gas": 24, "coal": 18, "nuclear": 1.9, "wind": 2.86, "solar": 10.48, "biomass": 19.02, "geothermal": 1.35, "hydro": 2.08}
FUELS = {
    "natural_gas": ("gas-ct_MWh", "gas-cc_MWh"), "coal": ("coal_MWh",), "nuclear": ("nuclear_MWh",), "wind": ("wind-ons_MWh", "wind-ofs_MWh"),
    "solar": ("csp_MWh", "upv_MWh", "distpv_MWh", "o-g-s_MWh"), "biomass": ("biomass_MWh",), "geothermal": ("geothermal_MWh",), "hydro": ("phs_MWh", "hydro_MWh"),
}


def codes(statuses: DataFrame, key: str, leaf_codes: DataFrame) -> DataFrame:
    """key, code of what is present, with the codes that follow: NIT and BIO-P; lagoons go where there is
    secondary treatment."""
    present = statuses.filter(st.is_present(F.col("status"))).join(rel.small(leaf_codes.withColumnRenamed("leaf", "process")), "process")
    own = present.select(key, F.explode("codes").alias("code")).distinct()
    has = lambda *c: F.max(F.col("code").isin(*c))
    flags = own.groupBy(key).agg(has("BNIT", "BNR", "AS-BDENIT", "AS-A2O").alias("NIT"), has("AS-A2O").alias("BIO-P"), has(*SECONDARY).alias("second"))
    more = flags.select(key, F.explode(F.array_compact(F.array(F.when(F.col("NIT"), "NIT"), F.when(F.col("BIO-P"), "BIO-P")))).alias("code"))
    lagoons = own.filter(F.col("code").isin(*LAGOONS)).join(flags.filter("second").select(key), key, "left_semi")
    return own.join(lagoons, [key, "code"], "left_anti").unionByName(more).distinct()


def pivoted(rows: DataFrame, key: str, every: Sequence[str]) -> DataFrame:
    """key and one 0/1 column per code."""
    return rows.groupBy(key).pivot("code", list(every)).agg(F.max(F.lit(1))).na.fill(0)


def with_flags(rows: DataFrame, key: str) -> DataFrame:
    """key, code with the combined flags that trains are told by."""
    has = lambda *c: F.coalesce(F.max(F.col("code").isin(*c)), F.lit(False))
    both = F.max(F.col("code") == "AS") & F.max(F.col("code") == "BNR")
    made = rows.groupBy(key).agg(
        has("AS", "AS-EA", "AS-SA", "AS-OD", "AS-SBR").alias("BASIC_AS"),
        (has("AS-A2O", "AS-BDENIT") | both).alias("AS_BNR_N"),
        has("TF", "TF-BF", "TF-RBC").alias("TF_ALL"),
        ((has("AS", "AS-A2O", "AS-BDENIT", "AS-EA", "AS-P", "AS-PUREO", "AS-SA") & has("BIO-P")) | has("AS-P")).alias("AS_BNR_P"),
        has("LAGOON", "STBL_POND").alias("LAGOON_UNCATEGORIZED"),
    )
    names = [c for c in made.columns if c != key]
    flags = made.select(key, F.explode(F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)))).alias("code"))
    return rows.unionByName(flags).distinct()


def external(rows: DataFrame, key: str, nitrifies: DataFrame, biogas: DataFrame) -> DataFrame:
    """key, code with what other registers know: nitrification, and biogas, which implies a digester."""
    keys = rows.select(key).distinct()
    more = [keys.join(df.select(key).distinct(), key, "left_semi").select(key, F.lit(code).alias("code")) for df, code in ((nitrifies, "NIT"), (biogas, "AND"), (biogas, "BIOGAS_EL"))]
    return rows.unionByName(more[0]).unionByName(more[1]).unionByName(more[2]).distinct()


def any_yes(columns: Sequence[str]) -> Column:
    """Whether any of the columns says yes."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(f"`{c}`") == "yes", F.lit(False))
    return out


def trains(rows: DataFrame, key: str, requires: DataFrame) -> DataFrame:
    """key, train: every train all of whose required codes (train, code) a facility has; lagoons are their
    own trains."""
    needs = requires.select("train", "code").distinct()
    needs = needs.join(needs.groupBy("train").agg(F.count(F.lit(1)).alias("need")), "train")
    met = rows.select(key, "code").distinct().join(rel.small(needs), "code").groupBy(key, "train", "need").agg(F.count(F.lit(1)).alias("have"))
    lagoon = rows.filter(F.col("code").isin(*LAGOON_TRAINS)).select(key, F.col("code").alias("train"))
    return met.filter("have = need").select(key, "train").unionByName(lagoon).distinct()


def _base(train: Column) -> Column:
    """A train without biogas electricity."""
    return F.when(F.endswith(train, F.lit("E")), F.substring(train, F.lit(1), F.length(train) - 1)).otherwise(train)


def ranked(assigned: DataFrame, *by: str) -> DataFrame:
    """by, train, place: the commonest first, ties by name; trains with electricity count for their base."""
    n = assigned.groupBy(*by, _base(F.col("train")).alias("train")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "train"))).drop("n")


def flow_bin(flow: Column) -> Column:
    return nb.binned(flow, EDGES, BINS)


def fallback(facilities: DataFrame, key: str, rows: DataFrame, assigned: DataFrame, requires: DataFrame) -> DataFrame:
    """key, train for ``facilities`` (key, flow) without a train in ``assigned``: from the trains of its flow bin,
    the commonest first, else from all, one on the same side of nitrification, no lagoon above the
    largest lagoon's flow, and of those rather one that requires a reported code."""
    binned_ = facilities.withColumn("bin", flow_bin(F.col("flow")))
    known = rel.saved(assigned.join(binned_, key))
    top = known.filter(F.col("train").isin(*LAGOON_TRAINS)).agg(F.max("flow")).first()[0]
    by_bin = ranked(known, "bin").select("bin", "train", "place", F.lit(0).alias("stage"))
    of_all = ranked(known.withColumn("bin", F.lit(None).cast("string")), "bin").select("train", "place", F.lit(1).alias("stage"))
    nitrifies = requires.groupBy("train").agg(F.max(F.col("code").isin(*NITRIFYING)).alias("train_nitrifies"))
    reported = rows.filter(F.col("code").isin(*KEY_CODES))
    open_ = binned_.join(assigned.select(key).distinct(), key, "left_anti")
    open_ = open_.join(reported.filter(F.col("code").isin(*NITRIFYING)).select(key, F.lit(True).alias("nitrifies")).distinct(), key, "left").fillna(False, ["nitrifies"])
    open_ = rel.saved(open_)
    sided = lambda df: rel.small(rel.saved(df.join(nitrifies, "train", "left").fillna(False, ["train_nitrifies"]).withColumnRenamed("train_nitrifies", "nitrifies")))
    asked = open_.join(sided(by_bin), ["bin", "nitrifies"]).select(key, "flow", "train", "place", "stage")
    asked = asked.unionByName(open_.join(sided(of_all), "nitrifies").select(key, "flow", "train", "place", "stage"))
    if top is not None:
        asked = asked.filter((F.col("flow") <= top) | ~F.col("train").isin(*LAGOON_TRAINS))
    fits = reported.join(rel.small(requires), "code").select(key, "train", F.lit(True).alias("fits")).distinct()
    asked = asked.join(fits, [key, "train"], "left")
    order = F.struct("stage", F.col("fits").isNull().alias("unfit"), "place")
    return asked.groupBy(key).agg(F.min_by("train", order).alias("train"))


def flows(assigned: DataFrame, facilities: DataFrame, key: str) -> DataFrame:
    """key, train, flow: a facility's flow in equal parts over its trains."""
    n = Window.partitionBy(key)
    return assigned.distinct().withColumn("__n", F.count(F.lit(1)).over(n)).join(facilities.select(key, "flow"), key).select(key, "train", (F.col("flow") / F.col("__n")).alias("flow"))


def emitted(shares: DataFrame, factors: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """key, gas, kg_per_day: the product of flows and factors, summed over trains. Factors are kg CO2e per
    cubic metre; of elec kWh per MGD, times the facility's kg CO2 per kWh (``grid``: key, kg_per_kwh). A
    train without factors adds nothing (see ``unfactored``)."""
    per_gas = shares.join(rel.small(factors), "train").groupBy(key, "gas").agg(F.sum(F.col("flow") * F.col("factor")).alias("product"))
    joined = per_gas.join(grid.select(key, "kg_per_kwh"), key, "left")
    missing = F.raise_error(F.concat(F.lit("no grid intensity for "), F.col(key).cast("string"))).cast("double")
    by_power = F.col("product") * F.when(F.col("kg_per_kwh").isNull(), missing).otherwise(F.col("kg_per_kwh"))
    return joined.select(key, "gas", F.when(F.col("gas") == "elec", by_power).otherwise(F.col("product") * M3_PER_MG).alias("kg_per_day"))


def unfactored(shares: DataFrame, factors: DataFrame) -> DataFrame:
    """train, flow of the trains that have no factors."""
    return shares.join(rel.small(factors.select("train").distinct()), "train", "left_anti").groupBy("train").agg(F.sum("flow").alias("flow"))


def totals(rows: DataFrame, facilities: DataFrame, *by: str) -> DataFrame:
    """by, n_facilities, flow, kt a year of each gas, of each scope and of all."""
    gases = (*SCOPE_1, *SCOPE_2, *SCOPE_3)
    kt = lambda names: F.coalesce(F.sum(F.when(F.col("gas").isin(*names), F.col("kg_per_day"))), F.lit(0.0)) * KT_PER_YEAR
    if not by:
        return totals(rows.withColumn("__all", F.lit(0)), facilities.withColumn("__all", F.lit(0)), "__all").drop("__all")
    sums = rows.groupBy(*by).agg(*(kt([g]).alias(g + "_kt") for g in gases), kt(SCOPE_1).alias("scope1_kt"), kt(SCOPE_2).alias("scope2_kt"), kt(SCOPE_3).alias("scope3_kt"), kt(gases).alias("total_kt"))
    sizes = facilities.groupBy(*by).agg(F.count(F.lit(1)).alias("n_facilities"), F.sum("flow").alias("flow"))
    return sizes.join(sums, list(by), "left").na.fill(0.0)


def grid_intensity(areas: DataFrame) -> DataFrame:
    """area, kg_per_kwh from generation by fuel (MWh), emissions at the plant (Mt) and upstream chains."""
    kg = F.col("co2_gen_mmt") * 1e9
    for fuel, columns in FUELS.items():
        for c in columns:
            kg = kg + F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) * (UPSTREAM[fuel] / 1000 * 3.6 * 1000)
    return areas.select("area", (kg / F.col("generation") / 1000).alias("kg_per_kwh"))


def source(statuses: DataFrame, link: DataFrame, leaf_codes: DataFrame, requires: DataFrame, registers: tuple[DataFrame, DataFrame] | None = None, proxy: bool = False) -> tuple[DataFrame, DataFrame]:
    """The facilities (facility, flow) of one source and their trains (facility, train): codes of what is present,
    carried to ``link`` (place_id, facility, flow), with registers or a proxy for biogas, then trains and
    fallback."""
    rows = rel.saved(codes(statuses, "place_id", leaf_codes).join(link.select("place_id", "facility"), "place_id").select("facility", "code").distinct())
    if proxy:
        gas = rows.filter("code IN ('BIOGAS_CWNS', 'AND')").groupBy("facility").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
        rows = rows.unionByName(gas.select("facility", F.lit("BIOGAS_EL").alias("code")))
    if registers:
        rows = external(rows, "facility", *registers)
    rows = rel.saved(with_flags(rows, "facility"))  # trains and the fallback read it several times
    facilities = link.join(statuses.select("place_id").distinct(), "place_id", "left_semi").select("facility", "flow").distinct()
    assigned = rel.saved(trains(rows, "facility", requires))
    return facilities, assigned.unionByName(fallback(facilities, "facility", rows, assigned, requires))
