"""Donor support, acquisition plans and design audits over cohort registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import flags
from tallyweave.operators.contracts import ContractError
from tallyweave.operators.sizing import small_side, with_scalar
from tallyweave.session import cut


def _reasons(cases: dict[str, Column]) -> Column:
    return F.array_join(flags(cases), ";")


def donor_support(weeks: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Every cohort-week against every other cohort as donor, with the three clock rules.

    ``weeks`` is a flagged event calendar, ``cohorts`` the registry. The pairing is inherent
    to the audit and both sides are registries; the registry is broadcast after its size check.
    """
    donors = cohorts.select(
        F.col("cohort_id").alias("donor_cohort_id"),
        F.col("chain").alias("donor_chain"),
        F.col("market_available_by_utc").alias("_open"),
        F.col("anticipation_utc").alias("_known"),
        F.col("activation_utc").alias("_treated"),
    )
    pairs = weeks.drop("anticipation_utc", "market_available_by_utc", "activation_utc").join(
        small_side(donors), F.col("cohort_id") != F.col("donor_cohort_id")
    )
    active = F.col("_open") <= F.col("window_start_utc")
    fresh = F.col("_known") >= F.col("window_end_utc_exclusive")
    untreated = F.col("_treated") >= F.col("window_end_utc_exclusive")
    return pairs.select(
        F.col("cohort_id").alias("target_cohort_id"),
        F.col("event_week").alias("target_event_week"),
        "window_start_utc",
        "window_end_utc_exclusive",
        "donor_cohort_id",
        "donor_chain",
        active.alias("donor_market_active_for_full_week"),
        fresh.alias("donor_not_yet_anticipated_for_full_week"),
        untreated.alias("donor_not_yet_treated_for_full_week"),
        (active & fresh & untreated).alias("eligible_donor"),
        _reasons({"market-not-yet-active": ~active, "anticipation-started": ~fresh, "already-treated": ~untreated}).alias("exclusion_reason"),
    )


def week_support(weeks: DataFrame, donors: DataFrame, minimum_donors: int = 1) -> DataFrame:
    """Eligible donors per cohort-week and whether a required week has enough of them."""
    eligible = F.when(F.col("eligible_donor"), F.col("donor_cohort_id").cast("string"))
    counts = donors.groupBy(F.col("target_cohort_id").alias("cohort_id"), F.col("target_event_week").alias("event_week")).agg(
        F.count_if("eligible_donor").alias("eligible_donor_count"),
        F.array_join(F.array_sort(F.collect_set(eligible)), ";").alias("eligible_donor_cohort_ids"),
    )
    out = weeks.join(counts, ["cohort_id", "event_week"], "left").fillna(0, ["eligible_donor_count"]).fillna("", ["eligible_donor_cohort_ids"])
    return out.withColumn("donor_support_gate", ~F.col("required") | (F.col("eligible_donor_count") >= minimum_donors))


def cohort_support(support: DataFrame, cohorts: DataFrame, minimum_week: int = -16, minimum_clean_pre: int = 8, minimum_donors: int = 1, days: int = 7) -> DataFrame:
    """Roll-up per cohort: clean and contaminated pre weeks, donor coverage, gates, reasons."""
    required = F.col("required")
    rolled = support.groupBy("cohort_id").agg(
        F.count_if("clean_pre").alias("clean_pre_week_count"),
        F.count_if("contaminated_pre").alias("anticipation_contaminated_pre_week_count"),
        F.count_if(required).alias("required_week_count"),
        F.count_if(required & F.col("donor_support_gate")).alias("required_weeks_with_donor_support"),
        F.coalesce(F.min(F.when(required, F.col("eligible_donor_count"))), F.lit(0)).alias("minimum_eligible_donors_in_required_weeks"),
    )
    out = cohorts.join(rolled, "cohort_id")
    start = F.col("activation_utc") + F.make_interval(days=F.lit(minimum_week * days))
    preexisting = F.col("market_available_by_utc") <= start
    trend = F.col("clean_pre_week_count") >= minimum_clean_pre
    donor = (F.col("required_weeks_with_donor_support") == F.col("required_week_count")) & (
        F.col("minimum_eligible_donors_in_required_weeks") >= minimum_donors
    )
    bundled = F.col("market_bundled_with_treatment")
    reasons = {
        "market-not-active-at-window-start": ~preexisting,
        "insufficient-clean-pre-weeks-after-anticipation": ~trend,
        "incomplete-not-yet-anticipated-donor-support": ~donor,
        "market-and-treatment-bundled": bundled,
    }
    return out.withColumns(
        {
            "market_preexisting_at_window_start": preexisting,
            "pretrend_support_gate": trend,
            "donor_support_gate": donor,
            "activation_did_design_gate": preexisting & trend & donor & ~bundled,
            "failure_reasons": _reasons(reasons),
        }
    )


def acquisition_windows(support: DataFrame, minimum_week: int = -16, maximum_week: int = 16, days: int = 7) -> DataFrame:
    """Scan window of each cohort and the analysis role its gate allows."""
    gate = F.col("activation_did_design_gate")
    return support.select(
        "cohort_id",
        "chain",
        (F.col("activation_utc") + F.make_interval(days=F.lit(minimum_week * days))).alias("window_start_utc"),
        (F.col("activation_utc") + F.make_interval(days=F.lit((maximum_week + 1) * days))).alias("window_end_utc_exclusive"),
        gate.alias("activation_did_design_gate"),
        F.when(gate, F.lit("causal-diagnostics-pending-data-and-assumptions"))
        .otherwise(F.lit("descriptive-and-network-comparison"))
        .alias("default_analysis_role"),
    )


def contemporaneous_support(treatments: DataFrame, donors: DataFrame, window_weeks: int = 16, minimum_donors: int = 2) -> DataFrame:
    """Per cohort and clock: donors of other chains that existed before the pre window.

    ``treatments`` has ``cohort_id, chain, chain_id, bundled_market_entry,
    formal_commitment_utc, operational_activation_utc``; ``donors`` has ``market_id, chain_id,
    status, first_seen_utc``.
    """
    clocks = ("formal_commitment", "operational_activation")
    cells = F.array(*[F.struct(F.lit(c).alias("clock"), F.col(f"{c}_utc").alias("event_utc")) for c in clocks])
    events = treatments.withColumn("_c", F.explode(cells)).select(
        "cohort_id", "chain", "chain_id", "bundled_market_entry", F.col("_c.clock").alias("clock"), F.col("_c.event_utc").alias("event_utc")
    ).withColumn("clean_pre_start_utc", F.col("event_utc") - F.make_interval(days=F.lit(7 * window_weeks)))
    verified = donors.where((F.col("status") == "verified") & F.col("first_seen_utc").isNotNull()).select(
        "market_id", F.col("chain_id").alias("_chain"), "first_seen_utc"
    )
    fits = (F.col("first_seen_utc") <= F.col("clean_pre_start_utc")) & (F.col("_chain") != F.col("chain_id"))
    matched = events.join(small_side(verified), fits, "left")
    keys = ["cohort_id", "chain", "chain_id", "clock", "event_utc", "clean_pre_start_utc", "bundled_market_entry"]
    out = matched.groupBy(*keys).agg(
        F.count("market_id").alias("eligible_donor_count"),
        F.array_join(F.array_sort(F.collect_set(F.col("market_id").cast("string"))), ";").alias("eligible_market_ids"),
    )
    gate = (F.col("eligible_donor_count") >= minimum_donors) & ~F.col("bundled_market_entry")
    return out.withColumns({"window_weeks": F.lit(window_weeks), "support_gate": gate})


def support_summary(support: DataFrame, minimum_cohorts: int = 3) -> DataFrame:
    """Supported cohorts per clock and the minimum-cohort gate."""
    passed = F.when(F.col("support_gate"), F.col("cohort_id").cast("string"))
    out = support.groupBy("clock").agg(
        F.count_if("support_gate").alias("supported_cohort_count"), F.array_join(F.array_sort(F.collect_set(passed)), ";").alias("supported_cohorts")
    )
    return out.withColumn("mvp_gate", F.col("supported_cohort_count") >= minimum_cohorts)


def acquisition_plan(support: DataFrame, treatments: DataFrame, markets: DataFrame, donors: DataFrame, minimum_donors: int = 2, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Unit jobs of every supported analysis and one merged scan per chain and contract.

    ``markets`` (treated, by chain_id) and ``donors`` (by market_id) carry ``chain, chain_id,
    pool_address``. A missing treated market, an unknown donor or too few donors is refused.
    """
    live = cut(support.where("support_gate"))
    span = F.make_interval(days=F.col("window_weeks") * 7)
    analyses = live.select(
        F.concat_ws("__", F.col("cohort_id").cast("string"), "clock").alias("analysis_id"),
        "clock",
        "cohort_id",
        "event_utc",
        "window_weeks",
        (F.col("event_utc") - span).alias("window_start_utc"),
        (F.col("event_utc") + span).alias("window_end_utc"),
        "eligible_market_ids",
    )
    own = treatments.select("cohort_id", F.col("chain_id").alias("_chain"))
    place = markets.where("verification_status = 'verified_locked_registry'").select(
        F.col("chain_id").alias("_chain"), "chain", "chain_id", "pool_address"
    )
    treated = analyses.join(own, "cohort_id").join(place, "_chain", "left").withColumns(
        {"role": F.lit("treated"), "market_id": F.col("cohort_id").cast("string")}
    ).drop("_chain", "eligible_market_ids")
    ids = F.explode(F.split("eligible_market_ids", ";"))
    listed = analyses.withColumn("market_id", ids).where("market_id <> ''").drop("eligible_market_ids")
    known = donors.select(F.col("market_id").cast("string").alias("market_id"), "chain", "chain_id", "pool_address")
    donor_jobs = listed.join(known, "market_id", "left").withColumn("role", F.lit("donor"))
    jobs = treated.unionByName(donor_jobs).withColumn(
        "primary_sample", F.col("clock") == "formal_commitment"
    ).withColumn("event_families", F.lit("Supply;Withdraw;Borrow;Repay;LiquidationCall"))
    jobs = cut(jobs)
    if strict:
        missing = jobs.where(F.col("pool_address").isNull()).limit(1).collect()
        if missing:
            raise ContractError(f"no verified market for {missing[0].analysis_id} {missing[0].market_id}")
        thin = jobs.groupBy("analysis_id").agg(F.count_if(F.col("role") == "donor").alias("n")).where(F.col("n") < minimum_donors)
        short = thin.limit(1).collect()
        if short:
            raise ContractError(f"{short[0].analysis_id} has fewer than {minimum_donors} donors")
    scans = jobs.groupBy("chain_id", F.lower("pool_address").alias("pool_address")).agg(
        F.first("chain").alias("chain"),
        F.min("window_start_utc").alias("scan_start_utc"),
        F.max("window_end_utc").alias("scan_end_utc"),
        F.array_join(F.array_sort(F.collect_set("analysis_id")), ";").alias("analysis_ids"),
    )
    return jobs, scans


def plan_summary(jobs: DataFrame, scans: DataFrame, minimum_cohorts: int = 3, minimum_donors: int = 2) -> DataFrame:
    per = jobs.groupBy("analysis_id").agg(F.count_if(F.col("role") == "donor").alias("n"))
    out = jobs.agg(
        F.count_distinct("analysis_id").alias("analysis_count"),
        F.count(F.lit(1)).alias("unit_job_count"),
        F.count_distinct(F.when(F.col("clock") == "formal_commitment", F.col("cohort_id"))).alias("formal_cohort_count"),
        F.count_distinct(F.when(F.col("clock") == "operational_activation", F.col("cohort_id"))).alias("activation_cohort_count"),
    )
    out = with_scalar(out, scans.agg(F.count(F.lit(1)).alias("deduplicated_chain_scans")))
    out = with_scalar(out, per.agg(F.coalesce(F.min("n"), F.lit(0)).alias("minimum_donors_per_analysis")))
    return out.withColumn(
        "plan_valid", (F.col("formal_cohort_count") >= minimum_cohorts) & (F.col("minimum_donors_per_analysis") >= minimum_donors)
    )


def design_audit(treatments: DataFrame, donors: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: clock errors, verified donor and route counts, and the two design gates."""
    rules = {
        "commitment_not_before_activation": F.col("formal_commitment_utc") >= F.col("operational_activation_utc"),
        "bundled_flag_mismatch": F.col("bundled_market_entry") != (F.col("market_available_by_utc") == F.col("operational_activation_utc")),
        "missing_source_url": ~F.coalesce(F.col("formal_commitment_source").startswith("https://"), F.lit(False)),
    }
    out = treatments.agg(
        F.count(F.lit(1)).alias("treatment_cohort_count"),
        (F.count(F.lit(1)) - F.count_distinct("cohort_id")).alias("duplicate_cohort_ids"),
        *[F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()],
    )
    donor = donors.agg(
        F.count(F.lit(1)).alias("candidate_donor_count"), F.count_if(F.col("verification_status") == "verified").alias("verified_donor_count")
    )
    route = routes.agg(
        F.count_if(F.col("configuration_status") == "historically_verified").alias("historically_verified_route_count"),
        F.count_if(F.col("configuration_status") == "current_verified").alias("current_verified_route_count"),
    )
    out = with_scalar(with_scalar(out, donor), route)
    errors = F.col("duplicate_cohort_ids") + sum((F.col(n) for n in rules), F.lit(0))
    return out.withColumns(
        {
            "status": F.when(errors > 0, F.lit("invalid")).otherwise(F.lit("design_valid_evidence_pending")),
            "formal_commitment_staggered_did_gate": (F.col("verified_donor_count") >= 2) & (F.col("treatment_cohort_count") >= 3),
            "bridge_metric_gate": (F.col("historically_verified_route_count") >= 2) | (F.col("current_verified_route_count") >= 2),
        }
    )


def verification_gate(donors: DataFrame, minimum_verified: int, status: str = "status") -> DataFrame:
    """Verified, selected and failed donor counts against a minimum."""
    if minimum_verified < 1:
        raise ValueError("minimum_verified must be positive")
    out = donors.agg(F.count(F.lit(1)).alias("selected"), F.count_if(F.col(status) == "verified").alias("verified"))
    return out.withColumns(
        {
            "failed": F.col("selected") - F.col("verified"),
            "minimum_verified": F.lit(minimum_verified),
            "support_audit_eligible": F.col("verified") >= minimum_verified,
            "all_verified": F.col("verified") == F.col("selected"),
        }
    )
