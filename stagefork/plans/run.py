"""A whole run, stage by stage, that goes on where an earlier one broke off.

A stage is finished if its table is whole and its metadata (settings, code, Spark's
version, fingerprint of the inputs) is today's. Stages that read a stage which was
written anew are written anew, too. The intervention log is made shard by shard, so
that workers can share it and a broken shard is made again alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import effects as E, inference as I, interventions as V, mediation as M, stability as S, verdict as D
from ..sources import artifacts as A
from ..sources.store import complete, exists, move
from ..operators.worlds import Retrieval

#: Mean gain of the whole pipeline below which a run ends.
LEAST_NDCG = 0.15


@dataclass
class Stage:
    """`build` takes the run and gives a table; `needs` names the stages whose tables it reads."""

    build: Callable[[Run], DataFrame]
    needs: tuple[str, ...] = ()


@dataclass
class Run:
    """One run over `sf_dir`, whose artefacts lie below `out`."""

    spark: SparkSession
    sf_dir: str
    out: str
    shards: int = 1
    settings: dict = field(default_factory=dict)
    least_ndcg: float = LEAST_NDCG
    #: Names of the stages that this run has made; others were finished before.
    made: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.out = self.out.rstrip("/")
        self.r = Retrieval(self.spark, self.sf_dir)

    @property
    def meta(self) -> dict:
        return A.run_meta({"shards": self.shards, **self.settings}) | {"inputs": self.r.data}

    def path(self, name: str) -> str:
        return f"{self.out}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def finished(self, name: str) -> bool:
        return complete(self.spark, self.path(name)) and not A.stale(self.spark, self.path(f"meta/{name}"), self.meta)

    def _keep(self, name: str, rows: DataFrame) -> None:
        """Write a stage beside its place and move it there; its metadata comes last."""
        half = self.path(f"half/{name}-{uuid.uuid4().hex}")
        rows.write.parquet(half)
        A.remove(self.spark, self.path(f"meta/{name}"))
        A.remove(self.spark, self.path(name))
        move(self.spark, half, self.path(name))
        A.write_json(self.spark, self.meta, self.path(f"meta/{name}"))
        self.made.append(name)

    def work(self, shard: int) -> None:
        """One shard of the intervention log, unless it is finished."""
        name = f"log_shards/of{self.shards}/shard={shard}"
        if not self.finished(name):
            own = Retrieval(self.spark, self.sf_dir, shard=(shard, self.shards))
            self._keep(name, V.intervention_log(own))

    def merged_log(self) -> DataFrame:
        return A.merge_shards(self.spark, self.path(f"log_shards/of{self.shards}"), self.shards)

    def run(self, only: tuple[str, ...] | None = None, force: bool = False) -> dict[str, DataFrame]:
        """All stages, or those in `only`, in order; tables by name."""
        for name, stage in STAGES.items():
            if only is not None and name not in only:
                continue
            if force or not self.finished(name) or set(stage.needs) & set(self.made):
                if missing := [n for n in stage.needs if not exists(self.spark, self.path(n))]:
                    raise ValueError(f"{name} needs {missing}")
                self._keep(name, stage.build(self))
            if name == "ndcg":
                self._gate()
        return {name: self.table(name) for name in STAGES if complete(self.spark, self.path(name))}

    def _gate(self) -> None:
        row = self.table("ndcg").first()
        if row["full_pipeline"] is not None and row["full_pipeline"] < self.least_ndcg:
            raise ValueError(f"the pipeline's mean gain of {row['full_pipeline']} is below {self.least_ndcg}: nothing behind it can be trusted")


def _log(run: Run) -> DataFrame:
    for shard in range(run.shards):
        run.work(shard)
    return run.merged_log()


def _ndcg(run: Run) -> DataFrame:
    from .queries import BUILDERS

    return BUILDERS["ndcg_summary"](run.r)


def _effects(run: Run) -> DataFrame:
    panel = run.table("panel")
    return E.dml_compare(E.naive_ols(panel), E.dml_plr(panel))


def _criteria(run: Run) -> DataFrame:
    ratio = run.table("mediation_ratio")
    return D.criteria(run.table("contrast"), ratio, M.mediation_shift(ratio), run.table("effects"))


STAGES: dict[str, Stage] = {
    "baseline": Stage(lambda run: run.r.baseline),
    "ndcg": Stage(_ndcg, ("baseline",)),
    "interventions": Stage(_log, ("baseline",)),
    "origin_documents": Stage(lambda run: V.origin_documents(run.r, run.table("interventions")), ("interventions",)),
    "arm_means": Stage(lambda run: I.arm_means(run.table("interventions")), ("interventions",)),
    "contrast": Stage(lambda run: I.bootstrap_diff_ci(run.table("interventions")), ("interventions",)),
    "design": Stage(lambda run: V.design_checks(run.table("interventions")), ("interventions",)),
    "mediation": Stage(lambda run: M.mediation_paths(run.r), ("interventions",)),
    "mediation_ratio": Stage(lambda run: M.mediation_ratio(run.table("mediation")), ("mediation",)),
    "stability_raw": Stage(lambda run: S.stability_raw(run.r), ("baseline",)),
    "stability": Stage(lambda run: S.stability_summary(run.table("stability_raw")), ("stability_raw",)),
    "panel": Stage(lambda run: E.dml_panel(run.r), ("baseline",)),
    "effects": Stage(_effects, ("panel",)),
    "criteria": Stage(_criteria, ("contrast", "mediation_ratio", "effects")),
}


def report(run: Run) -> str:
    """Markdown over a run's artefacts; a section whose artefact is missing says so."""
    found = A.load_artifacts(run.spark, run.out, tuple(STAGES))
    criteria = found.get("criteria")
    return A.report(found, None if criteria is None else D.verdict_text(criteria), A.read_json(run.spark, run.path("meta/baseline")))
