"""Which units may be written side by side, and how units are dealt to jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.plans.graph import connected_components
from mosaiq.plans.numbering import numbered


def conflict_edges(footprints: DataFrame, unit: str = "unit", chunk: str = "chunk") -> DataFrame:
    """Pairs (a, b), a < b, of units that write a chunk in common."""
    left, right = footprints.select(F.col(unit).alias("a"), chunk), footprints.select(F.col(unit).alias("b"), chunk)
    return left.join(right, chunk).where("a < b").select("a", "b").distinct()


def conflict_components(footprints: DataFrame, unit: str = "unit", chunk: str = "chunk") -> DataFrame:
    """(unit, component): units that must not be split over jobs share one, named by its first unit.

    Units are linked to the first unit of each of their chunks, so no pair is emitted twice.
    """
    first = footprints.groupBy(chunk).agg(F.min(unit).alias("b"))
    links = footprints.join(first, chunk).select(F.col(unit).alias("a"), "b").distinct()
    joined = connected_components(links).select(F.col("node").alias(unit), "component")
    return footprints.select(unit).distinct().join(joined, unit, "left").withColumn("component", F.coalesce("component", unit))


def jobs(components: DataFrame, n: int, unit: str = "unit") -> DataFrame:
    """(unit, job): whole components, the largest first to the job with the fewest units.

    The greedy choice runs on the driver over one row per component.
    """
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").collect()
    load, dealt = [0] * n, []
    for r in sizes:
        job = min(range(n), key=lambda j: (load[j], j))
        load[job] += r["size"]
        dealt.append((r["component"], job))
    table = components.sparkSession.createDataFrame(dealt, f"component {dict(components.dtypes)['component']}, job int")
    return components.join(table, "component").select(unit, "job")


def waves(units: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    """First-fit colours in order of the units: units of one wave have no chunk in common."""
    near: dict[int, set[int]] = {u: set() for u in units}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out: dict[int, int] = {}
    for u in sorted(units):
        taken = {out[v] for v in near[u] if v in out}
        out[u] = next(w for w in range(len(taken) + 1) if w not in taken)
    return out


def fingerprint(plan: DataFrame, columns: list[str], n_jobs: int) -> str:
    """A hash of a plan's geometry that does not depend on the order of its rows."""
    row = plan.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return plan.sparkSession.range(1).select(F.sha2(F.concat_ws("|", F.lit(str(n_jobs)), F.lit(str(row["n"])), F.lit(str(row["h"])), *[F.lit(c) for c in columns]), 256)).first()[0]


def merged_partials(partials: DataFrame, n_jobs: int, index: str = "index", row: str = "row", job: str = "job") -> DataFrame:
    """Partial results in order of (unit, row), numbered; a job without its mark is an error."""
    seen = {r[job] for r in partials.select(job).distinct().collect()}
    missing = sorted(set(range(n_jobs)) - seen)
    if missing:
        raise ValueError(f"no results of jobs {missing}")
    kept = partials.where(F.col(index).isNotNull())
    return numbered(kept, [index, row], "place", 0)
