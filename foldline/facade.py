"""One object for the whole life of an alphabet, and the engine's functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from foldline.functions.cigar import token_list
from foldline.operators.network import Model
from foldline.plans import alphabet, dataset, experiments, reporting, settings
from foldline.sources import readers


class StructuralAlphabet:
    """build_features, train, encode, evaluate and compare with one session; settings are files, dictionaries or Settings."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @staticmethod
    def _read(declared: dict, given, overrides: dict | None) -> settings.Settings:
        if isinstance(given, settings.Settings):
            return given
        return settings.resolve(declared, given, overrides) if isinstance(given, dict) else settings.load(declared, given, overrides)

    def build_features(self, given, overrides: dict | None = None, force: bool = False) -> dict:
        return dataset.build(self.spark, self._read(settings.DATA, given, overrides), force)

    def validate(self, given, overrides: dict | None = None) -> dict:
        return dataset.validate(self.spark, self._read(settings.DATA, given, overrides))

    def train(self, given=None, overrides: dict | None = None) -> Model:
        return alphabet.train(self.spark, self._read(settings.TRAIN, given, overrides))

    def encode(self, pdb_dir: str, model: Model | str, center: list[float] | None = None) -> DataFrame:
        """sid, seq of every structure file of a folder."""
        model = Model.load(model) if isinstance(model, str) else model
        return alphabet.encode(readers.structure_files(self.spark, pdb_dir), model, alphabet.center_of(model, center))

    def evaluate(self, model_dir: str, pdb_dir: str, pairfile: str, out: str, center: list[float] | None = None) -> dict:
        return alphabet.evaluate(self.spark, model_dir, pdb_dir, pairfile, out, center)

    def compare(self, runs: dict[str, str], out: str | None = None) -> dict:
        return reporting.compare(runs, out)

    def compare_quantizers(self, given, pdb_dir: str, pairfile: str, out: str) -> dict:
        return experiments.compare_quantizers(self.spark, self._read(settings.TRAIN, given, None), pdb_dir, pairfile, out)


class CigarPairs:
    """A row k, i, j for each residue pair of an alignment string."""

    def eval(self, cigar: str) -> Iterator[tuple[int, int, int]]:
        k = i = j = 0
        for n, op in token_list(cigar or ""):
            if op == "P":
                yield from ((k + t, i + t, j + t) for t in range(n))
                k += n
            i, j = i + n * (op in "DMP"), j + n * (op in "IMP")


#: Functions in SQL's own words, so that they are expanded into the plan and stay in the JVM. A vector is an ARRAY<DOUBLE> of three.
SQL_FUNCTIONS = {
    "class_level(dotted STRING, n INT) RETURNS STRING": r"if(size(split(dotted, '\\.')) >= n, array_join(slice(split(dotted, '\\.'), 1, n), '.'), null)",
    "class_fold(dotted STRING) RETURNS STRING": "class_level(dotted, 2)",
    "class_superfamily(dotted STRING) RETURNS STRING": "class_level(dotted, 3)",
    "class_family(dotted STRING) RETURNS STRING": r"if(size(split(dotted, '\\.')) >= 4, dotted, null)",
    "class_parent(dotted STRING) RETURNS STRING": r"regexp_replace(dotted, '\\.[0-9]+$', '')",
    "domain_group(sid STRING) RETURNS STRING": "if(startswith(sid, 'd') and char_length(sid) >= 5, substring(sid, 2, 4), sid)",
    "mebibytes(n BIGINT) RETURNS STRING": "format_string('%.1f MiB', n / 1048576.0D)",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "a[0] * b[0] + a[1] * b[1] + a[2] * b[2]",
    "vector_sub(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "array(a[0] - b[0], a[1] - b[1], a[2] - b[2])",
    "vector_add(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "array(a[0] + b[0], a[1] + b[1], a[2] + b[2])",
    "vector_scale(a ARRAY<DOUBLE>, s DOUBLE) RETURNS ARRAY<DOUBLE>": "array(a[0] * s, a[1] * s, a[2] * s)",
    "vector_cross(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])",
    "vector_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(vector_dot(a, a))",
    "vector_unit(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "transform(a, x -> try_divide(x, sqrt(aggregate(a, 0D, (s, y) -> s + y * y))))",
    "vector_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "vector_norm(vector_sub(a, b))",
    "signed_log(delta DOUBLE) RETURNS DOUBLE": "signum(delta) * log1p(abs(delta))",
    "separation_of(f9 DOUBLE) RETURNS INT": "cast(rint(exp(abs(f9)) - 1) as int)",
}


def register(spark: SparkSession) -> None:
    """SQL_FUNCTIONS, and SELECT * FROM cigar_pairs('2M3P'), or with LATERAL beside a table. In DataFrames, functions.cigar.pairs stays in the JVM."""
    spark.udtf.register("cigar_pairs", udtf(CigarPairs, returnType="k bigint, i bigint, j bigint"))
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
