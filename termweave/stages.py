"""The stages of an experiment, from dumps to the ablation: each reads what those before it wrote, writes its results
and a manifest, and returns its report (output, status, rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import schemas
from .config import Experiment
from .operators import candidates as C, features as E, indexes as I, ranking as R, scoring as S
from .sources import download, ntriples, tables

#: relation -> the dump that it is parsed from.
DUMP_OF = {
    "labels": "labels", "instance_types": "instance_types", "literal_properties": "mappingbased_literals",
    "object_properties": "mappingbased_objects", "infobox_properties": "infobox_properties", "sameas_links": "commons_sameas_links",
}
RELATION_OF = {"literal": "literal_properties", "object": "object_properties", "infobox": "infobox_properties"}
Report = list[tuple[str, str, int]]


class Run:
    """One experiment in one session. limit: lines of each dump, for smoke runs."""

    def __init__(self, spark: SparkSession, experiment: Experiment, inputs: str | None = None, limit: int | None = None):
        self.spark, self.at, self.inputs, self.limit = spark, experiment, inputs, limit

    def _kept(self, rows: DataFrame, name: str) -> tuple[str, str, int]:
        """A table for the next stages."""
        tables.write_index(rows, name)
        return name, "OK", self.spark.read.parquet(name).count()

    def _shown(self, rows: DataFrame, name: str, columns: list[str] | None = None) -> tuple[str, str, int]:
        """A result, as CSV."""
        tables.write_csv(C.packed(rows), self.at.result(name), columns)
        return name, "OK", tables.read_csv(self.spark, self.at.result(name)).count()

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(name)

    def _relations(self) -> dict[str, DataFrame]:
        return {kind: self._table(self.at.table(name)) for kind, name in RELATION_OF.items()}

    def _result_table(self, name: str) -> str:
        return self.at.table(f"{self.at.name}_{name}")

    # ---- the stages ----

    def setup(self) -> Report:
        """Puts the reference terms and the gold standard where the experiment expects them."""
        if not self.inputs:
            raise ValueError("setup needs the folder of the inputs")
        report = []
        for target in (self.at.reference_terms(), self.at.gold()):
            source = f"{self.inputs.rstrip('/')}/{target.rpartition('/')[2]}"
            tables.copy_table(self.spark, source, target)
            report.append((target, "OK", tables.read_csv(self.spark, target).count()))
        return report

    def download(self) -> Report:
        found = download.fetch_all(self.at.dump("x").rpartition("/")[0])
        return [(name, status, 0) for name, status in found.items()]

    def preprocess(self) -> Report:
        dumps = {relation: self.at.dump(dump) for relation, dump in DUMP_OF.items()}
        return [tuple(r) for r in ntriples.preprocess(self.spark, dumps, self.at.table, limit=self.limit).collect()]

    def index(self) -> Report:
        labels, types, relations = self._table(self.at.table("labels")), self._table(self.at.table("instance_types")), self._relations()
        # the order among equals is kept for the candidates
        found = I.build_all(labels, types, relations) | {"property_frequency_index": I.property_frequency(relations)}
        return [self._kept(rows, self.at.index(name)) for name, rows in found.items()]

    def _terms(self) -> DataFrame:
        if self.at.name == "pilot":
            return tables.expand_terms(tables.pilot_terms(self.spark))
        return tables.expand_terms(tables.read_csv(self.spark, self.at.reference_terms(), schemas.REFERENCE_TERMS))

    def _frequency(self) -> DataFrame:
        return self._table(self.at.index("property_frequency_index"))

    def candidates(self) -> Report:
        terms = C.positioned(self._terms()).cache()
        try:
            found = C.generate(terms, self._table(self.at.table("labels")), self._table(self.at.table("instance_types")), self._frequency())
            kept = self._kept(found, self._result_table("candidates"))
        finally:
            terms.unpersist()
        rows = self._table(kept[0])
        return [kept, self._shown(rows, "candidates", schemas.CANDIDATE_COLUMNS), self._shown(tables.manifest(rows, "reference_entity_id"), "candidates_per_reference")]

    def features(self) -> Report:
        candidates = self._table(self._result_table("candidates"))
        rows = E.features(candidates, self._table(self.at.table("instance_types")), self._relations(), self._frequency())
        kept = self._kept(rows, self._result_table("features"))
        return [kept, self._shown(self._table(kept[0]), "features", [*schemas.CANDIDATE_COLUMNS, *schemas.FEATURE_COLUMNS])]

    def rank(self) -> Report:
        kept = self._kept(R.rank(S.final(self._table(self._result_table("features")))), self._result_table("ranked"))
        ranked = self._table(kept[0])
        columns = [*schemas.CANDIDATE_COLUMNS, *schemas.FEATURE_COLUMNS, *schemas.SCORE_COLUMNS, "rank"]
        return [kept, self._shown(R.sorted_ranks(ranked), "ranked_alignments", columns), self._shown(R.sorted_ranks(R.best(ranked)), "best_alignments", columns)]

    def _gold(self) -> DataFrame:
        return tables.gold(tables.read_csv(self.spark, self.at.gold(), schemas.GOLD))

    def evaluate(self) -> Report:
        rows = R.details(self._table(self._result_table("ranked")), self._gold(), self.at.name)
        return [self._shown(R.shown(rows).orderBy("reference_entity_id"), "evaluation_details"), self._shown(R.metrics(rows), "evaluation_metrics")]

    def ablation(self) -> Report:
        ranked = R.ablation_ranks(self._table(self._result_table("features")))
        kept = self._kept(ranked, self._result_table("ablation_rankings"))
        ranked, gold = self._table(kept[0]), self._gold()
        details = R.shown(R.ablation_details(ranked, gold, self.at.name))
        return [kept, self._shown(details.orderBy("ablation_model", "reference_entity_id"), "ablation_details"), self._shown(R.ablation_metrics(ranked, gold, self.at.name), "ablation_metrics")]

    def run(self, stage: str) -> Report:
        """The stage's report, which is also its manifest. What fails is in it, not raised."""
        try:
            report = STAGES[stage](self)
        except Exception as e:  # noqa: BLE001  reported, not swallowed
            report = [(stage, f"FAILED: {(str(e).splitlines() or [type(e).__name__])[0][:300]}", 0)]
        rows = self.spark.createDataFrame([(stage, *r) for r in report] or [(stage, stage, "FAILED: nothing", 0)], "stage string, output string, status string, rows long")
        tables.write_csv(rows.coalesce(1), self.at.result(f"manifest_{stage}"))
        return report


#: In the order in which they run.
STAGES: dict[str, Callable[[Run], Report]] = {
    "setup": Run.setup, "download": Run.download, "preprocess": Run.preprocess, "index": Run.index, "candidates": Run.candidates,
    "features": Run.features, "rank": Run.rank, "evaluate": Run.evaluate, "ablation": Run.ablation,
}


def failed(report: Report) -> bool:
    return not report or any(status != "OK" for _, status, _ in report)
