"""Batch jobs between zones, under the bank's own table and column names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bindings
from ..sources.tables import BucketedStore, Publication, Zones, cut_lineage, publication, read_table
from . import activity
from . import effect_base as eb
from . import segment_base as sb
from .effect_model import EffectResult, measure_effect
from .segment_model import Segmentation, SegmentModel, segment_clients
from .spec import EffectSpec, SegmentSpec

# Names of the modelling tables and of the stored model.
EFFECT_BASE, SEGMENT_BASE = "base_modelo", "base_segmentacion"
SEGMENTED, MODEL = "clientes_segmentados", "modelo_segmentacion"
# Results by client for lookups, and the rows of a bucket.
LOOKUP, ROWS_PER_BUCKET = "clientes_por_id", 1_000_000


def _trusted(spark: SparkSession, zones: Zones, table: str) -> DataFrame:
    df = read_table(spark, zones.table("trusted", bindings.TABLE_NAMES[table]))
    return bindings.to_package_names(df, table)


def _four(spark: SparkSession, zones: Zones) -> list[DataFrame]:
    return [_trusted(spark, zones, t) for t in ("client", "card", "tx", "contact")]


def _store(out: Publication, df: DataFrame, zones: Zones, name: str, binding: str) -> None:
    out.write(bindings.to_source_names(df, binding), zones.table("modelling", name))


def _modelling(spark: SparkSession, zones: Zones, name: str, binding: str) -> DataFrame:
    return bindings.to_package_names(read_table(spark, zones.table("modelling", name)), binding)


# The window lengths that are compared.
WINDOW_CANDIDATES = (30, 45, 60, 90, 120)


def build_effect_base(
    spark: SparkSession, zones: Zones, spec: EffectSpec = EffectSpec(),
    window_candidates: tuple[int, ...] = WINDOW_CANDIDATES,
) -> None:
    """Stores the causal table, the sizes of cohort and arms, how many windows of each length fit, and the mean
    outcomes by length. The tables of all lengths come from one pass over the transactions."""
    with publication(spark, zones.root) as out:
        client, card, tx, contact = _four(spark, zones)
        cohort = eb.pilot_cohort(client, contact, spec.campaign)
        arms = cut_lineage(eb.with_arms(cohort, eb.first_activation(card, spec.labels.physical)))
        out.write(eb.arm_sizes(arms), zones.table("reports", "cohort_sizes"))
        lengths = sorted({*window_candidates, spec.window_days})
        windows = eb.window_sensitivity(eb.anchored(arms), tx, lengths)
        out.write(windows, zones.table("reports", "window_sensitivity"))
        bases = cut_lineage(activity.effect_bases(client, card, tx, contact, lengths, spec))
        out.write(activity.outcomes_by_window(bases), zones.table("reports", "outcomes_by_window"))
        base = bases.where(F.col("window_days") == spec.window_days).drop("window_days")
        _store(out, base, zones, EFFECT_BASE, "effect_base")


def run_effect(spark: SparkSession, zones: Zones, replicates: int = 2_000, seed: int = 42) -> EffectResult:
    """Measures the effect from the stored causal table.

    Stores the balance of numbers (largest gap first) and of categories, how many covariates are
    unbalanced, R², each client's effect and the decisions. The result reads what was stored.
    """
    reports = {}
    with publication(spark, zones.root) as out:
        result = measure_effect(_modelling(spark, zones, EFFECT_BASE, "effect_base"), replicates, seed)
        balance = cut_lineage(result.balance)
        reports["covariate_balance"] = balance.orderBy(F.desc(F.abs("smd")), "variable").coalesce(1)
        reports["unbalanced_covariates"] = balance.agg(
            F.count_if("unbalanced").alias("n_unbalanced"), F.count("*").alias("n_covariates")
        )
        reports |= {f"category_balance_{c}": table for c, table in result.categories.items()}
        reports |= {f"individual_effect_{y}": table for y, table in result.effects.items()}
        reports |= {"holdout_r2": result.learner.r2, "effect_decisions": result.decisions}
        for name, table in reports.items():
            out.write(table, zones.table("reports", name))
    stored = {name: read_table(spark, zones.table("reports", name)) for name in reports}
    return replace(
        result, balance=stored["covariate_balance"], decisions=stored["effect_decisions"],
        categories={c: stored[f"category_balance_{c}"] for c in result.categories},
        effects={y: stored[f"individual_effect_{y}"] for y in result.effects},
    )


def build_segment_base(spark: SparkSession, zones: Zones, spec: SegmentSpec = SegmentSpec()) -> None:
    with publication(spark, zones.root) as out:
        client, card, tx, contact = _four(spark, zones)
        exclusions = sb.exclusions(card, tx, contact).unionByName(sb.eligibility_counts(client, card, tx, spec))
        out.write(exclusions, zones.table("reports", "exclusions"))
        _store(out, sb.segment_features(client, card, tx, contact, spec), zones, SEGMENT_BASE, "segment_base")


def run_segmentation(
    spark: SparkSession, zones: Zones, candidates: tuple[int, ...] = (3, 4, 5, 6), seed: int = 42, starts: int = 10,
    by_score: bool = False,
) -> Segmentation:
    """Clusters the stored segmentation table; stores the labelled clients and the model.

    With ``by_score`` the clients are stored in files of falling priority score, highest first.
    """
    with publication(spark, zones.root) as out:
        base = _modelling(spark, zones, SEGMENT_BASE, "segment_base")
        result = segment_clients(base, candidates, seed, starts)
        clients = result.clients.orderBy(F.desc("priority_score"), "client_id") if by_score else result.clients
        _store(out, clients, zones, SEGMENTED, "segment_base")
        lookup = zones.table("modelling", LOOKUP)
        buckets = max(8, result.clients.count() // ROWS_PER_BUCKET)
        BucketedStore(out.path(lookup), buckets).save(result.clients, "client_id")
        out.note(lookup)
        model = f"{zones.folder('models')}/{MODEL}"
        result.model.save(spark, out.path(model))
        out.note(model)
        out.write(result.ranking, zones.table("reports", "segment_ranking"))
        out.write(result.profile(), zones.table("reports", "segment_profile"))
        out.write(result.modes(), zones.table("reports", "segment_modes"))
        out.write(result.distribution(), zones.table("reports", "segment_distribution"))
        out.write(result.choice.table(base), zones.table("reports", "silhouette_by_k"))
    return result


def load_model(spark: SparkSession, zones: Zones) -> SegmentModel:
    return SegmentModel.load(spark, f"{zones.folder('models')}/{MODEL}")


def find_clients(spark: SparkSession, zones: Zones, requests: DataFrame) -> DataFrame:
    """Stored segment of each requested ``client_id``; only the requests are shuffled."""
    return BucketedStore.open(spark, zones.table("modelling", LOOKUP)).many(requests, "client_id")


def find_client(spark: SparkSession, zones: Zones, client_id: str) -> DataFrame:
    """Stored segment of one client, from one bucket of the table."""
    return BucketedStore.open(spark, zones.table("modelling", LOOKUP)).one(spark, client_id)
