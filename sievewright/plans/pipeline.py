"""The screening pipeline: documents or chunks in, chunk and document results out."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators.chunking import DEFAULT_OVERLAP, DEFAULT_SIZE, check_sizes, chunk
from sievewright.operators.classification import Classifier
from sievewright.operators.layer1 import Layer1
from sievewright.operators.reports import document_report
from sievewright.operators.verdict import chunk_results, document_verdicts
from sievewright.sources.readers import Registry, read_documents


@dataclass(frozen=True)
class Analysis:
    """Tables of one run.  ``findings`` keeps every finding of every chunk; ``outcomes`` is None without layer 2."""

    chunks: DataFrame
    results: DataFrame
    findings: DataFrame
    documents: DataFrame
    outcomes: DataFrame | None = None
    log: DataFrame | None = None

    def ordered_findings(self) -> DataFrame:
        """All findings in the order of documents, chunks and places."""
        return self.findings.orderBy("doc_id", "chunk_index", "start_char", "end_char", "rule_id", "span")

    def chunk_result(self, doc_id: int, index: int) -> DataFrame:
        return self.results.where((self.results.doc_id == doc_id) & (self.results.chunk_index == index))

    def chunk_text(self, doc_id: int, index: int) -> str | None:
        row = self.chunks.where((self.chunks.doc_id == doc_id) & (self.chunks.chunk_index == index)).select("chunk_text").head()
        return row[0] if row else None

    def report(self) -> DataFrame:
        return document_report(self.results, findings=self.findings)


@dataclass(frozen=True)
class ScreeningPipeline:
    """Layer 1 on all chunks, layer 2 on those it routes.

    ``work_dir`` is where decisions and outcomes are written before they are read twice; by default the
    session's checkpoint folder.  So patterns run once over every chunk, and the classifier is called
    once for every routed one.
    """

    layer1: Layer1 = field(default_factory=Layer1)
    classifier: Classifier | None = None
    chunk_size: int = DEFAULT_SIZE
    chunk_overlap: int = DEFAULT_OVERLAP
    work_dir: str | None = None

    def __post_init__(self) -> None:
        check_sizes(self.chunk_size, self.chunk_overlap)

    def analyze_paths(self, spark: SparkSession, paths, registry: Registry | None = None) -> Analysis:
        return self.analyze(read_documents(spark, paths, registry).where("error is null").select("doc_id", "source", "text"))

    def analyze(self, documents: DataFrame) -> Analysis:
        """``documents`` has doc_id, source and text."""
        return self.analyze_chunks(chunk(documents, self.chunk_size, self.chunk_overlap))

    def analyze_chunks(self, chunks: DataFrame) -> Analysis:
        decided = self.decided_once(chunks)
        outcomes = None
        if self.classifier is not None:
            # the routed set is small and uneven; it is dealt anew before the expensive calls
            routed = decided.where("routed").select("doc_id", "chunk_index", "source", "start_char", "end_char", "chunk_text").repartition("doc_id", "chunk_index")
            outcomes = self._written(self.classifier.classify(routed).select("doc_id", "chunk_index", "outcome"), "outcomes")
        results = chunk_results(decided.drop("chunk_text"), outcomes)
        return Analysis(chunks, results, self.layer1.findings(decided), document_verdicts(results), outcomes, self.layer1.log(decided))

    def decided_once(self, chunks: DataFrame) -> DataFrame:
        """Layer 1 on all chunks, written; the text stays with chunks that are routed or that a rule hit."""
        decided = self.layer1.decide(chunks)
        needed = F.when(F.col("routed") | (F.size("rule_ids") > 0), F.col("chunk_text"))
        return self._written(decided.withColumn("chunk_text", needed), "decided")

    def _written(self, table: DataFrame, name: str) -> DataFrame:
        spark = table.sparkSession
        path = f"{self._folder(spark)}/sievewright/{name}-{uuid.uuid4().hex}"
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    def _folder(self, spark: SparkSession) -> str:
        """Where all executors read and write; a temporary folder only where the master is this machine."""
        folder = self.work_dir or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not folder:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("work_dir or spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sievewright-")
            spark.conf.set("spark.checkpoint.dir", folder)
        return folder.rstrip("/")


def build_pipeline(rules_path: str | None = None, scorer=None, classifier: Classifier | None = None, **options) -> ScreeningPipeline:
    from sievewright.operators.detection import RuleDetector

    detector = RuleDetector.from_file(rules_path) if rules_path else RuleDetector()
    return ScreeningPipeline(Layer1(detector, scorer), classifier, **options)
