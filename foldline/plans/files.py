"""Queries that write files and read them back, and others on files, errors and models, with their DuckDB oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.functions import hierarchy, quantize
from foldline.operators import pairs, search, splits, stats
from foldline.operators.network import Mlp, Model, encode_states
from foldline.plans import alphabet, catalog, dataset, inputs
from foldline.plans.catalog import DESCRIPTORS, EVENT_PAIRS, LEVELS, oracle
from foldline.plans.inputs import ALIGNMENTS, CHAINS, CLASSES, SEQUENCES, table
from foldline.sources import archives, arrayfiles, readers, writers
from foldline.sources.scratch import shared_folder
from foldline.sources.textfiles import write_lines


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _customer_lines(spark: SparkSession, sf: str, value: Column) -> str:
    """One file with a line for each customer in order of c_custkey; a file's lines are numbered, so it's one file."""
    path = f"{shared_folder(spark, 'lines')}/lines.txt"
    write_lines(table(spark, sf, "customer").select("c_custkey", value.alias("value")), F.col("value"), [F.col("c_custkey")], path)
    return path


NUMBERED = "n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS source_row FROM customer)"


@oracle(f"WITH {NUMBERED} SELECT source_row, 'd' || c_custkey AS sid1, 'd' || c_nationkey AS sid2, concat(c_custkey % 30 + 1, 'M', c_nationkey + 1, 'P') AS cigar FROM n WHERE c_custkey % 10 <> 0")
def pairfile_read(spark: SparkSession, sf: str) -> DataFrame:
    """A pairfile with tabs, runs of blanks and short lines, which count in source_row."""
    whole = F.concat(F.lit("  d"), _s("c_custkey"), F.lit("\td"), _s("c_nationkey"), F.lit("  0.7 "), _s(F.col("c_custkey") % 30 + 1), F.lit("M"), _s(F.col("c_nationkey") + 1), F.lit("P "))
    return readers.pairfile(spark, _customer_lines(spark, sf, F.when(F.col("c_custkey") % 10 == 0, "short\tline").otherwise(whole)))


@oracle(f"WITH {ALIGNMENTS} SELECT CAST(row_number() OVER (ORDER BY sid1, sid2, cigar, alignment_id) AS INTEGER) AS place, sid1, sid2, cigar, alignment_id FROM alignments ORDER BY sid1, sid2, cigar, alignment_id LIMIT 100")
def first_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred in the fixed order, with their places."""
    order = ["sid1", "sid2", "cigar", "alignment_id"]
    rows = inputs.alignments(spark, sf).orderBy(*order).limit(100)
    return rows.select(F.row_number().over(Window.orderBy(*order)).alias("place"), *order)


def _class_line() -> Column:
    key = F.col("c_custkey")
    dotted = F.concat(F.substring(F.lit("abcd"), (key % 4 + 1).cast("int"), F.lit(1)), F.lit("."), _s(key % 7), F.lit("."), _s(key % 3))
    return F.when(key % 9 == 0, F.concat(F.lit("d"), _s("c_nationkey"))).otherwise(F.concat(F.lit("d"), _s("c_nationkey"), F.lit("\t"), dotted))


CLASS_LINES = f"{NUMBERED}, l AS (SELECT source_row, 'd' || c_nationkey AS sid, concat(substr('abcd', CAST(c_custkey % 4 + 1 AS INTEGER), 1), '.', c_custkey % 7, '.', c_custkey % 3) AS class FROM n WHERE c_custkey % 9 <> 0)"


@oracle(f"WITH {CLASS_LINES} SELECT sid, arg_max(class, source_row) AS class FROM l GROUP BY 1")
def class_lookup_read(spark: SparkSession, sf: str) -> DataFrame:
    """A class lookup with ids that come again, of which the last counts, and lines without a class."""
    return readers.class_lookup(spark, _customer_lines(spark, sf, _class_line()))


@oracle(f"WITH {CLASS_LINES} SELECT source_row AS position, sid, class FROM l")
def class_list_read(spark: SparkSession, sf: str) -> DataFrame:
    return readers.class_list(spark, _customer_lines(spark, sf, _class_line()))


@oracle(f"WITH {NUMBERED} SELECT source_row AS position, 'd' || c_custkey AS sid FROM n WHERE c_custkey % 5 > 1")
def id_list_read(spark: SparkSession, sf: str) -> DataFrame:
    """An id list with comments, blank lines and a second word on some lines."""
    key = F.col("c_custkey")
    line = F.when(key % 5 == 0, "# comment").when(key % 5 == 1, "  ").when(key % 5 == 2, F.concat(F.lit("d"), _s(key), F.lit(" a.1"))).otherwise(F.concat(F.lit("d"), _s(key)))
    return readers.id_list(spark, _customer_lines(spark, sf, line))


@oracle(f"WITH {SEQUENCES} SELECT sid, seq FROM sequences")
def sequences_read(spark: SparkSession, sf: str) -> DataFrame:
    """A file of sequences, written and read."""
    path = f"{shared_folder(spark, 'sequences')}/sequences.txt"
    writers.sequences(inputs.sequences(spark, sf), path)
    return readers.sequences(spark, path)


SCORES = f"""{EVENT_PAIRS}, l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E', 'X']) AS c), p AS (SELECT a, b, n::DOUBLE / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a)::DOUBLE / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b)::DOUBLE / sum(n) OVER () AS pb FROM counts)
SELECT x.c AS a, y.c AS b, coalesce(CAST(round_even(2 * log2(p / (pa * pb)), 0) AS INTEGER), 0) AS score FROM l x CROSS JOIN l y LEFT JOIN p ON p.a = x.c AND p.b = y.c"""


@oracle(f"WITH {SCORES}")
def matrix_read(spark: SparkSession, sf: str) -> DataFrame:
    """The substitution matrix with a row and column for the invalid letter, as text with cells of four characters, read back."""
    path = f"{shared_folder(spark, 'matrix')}/matrix.txt"
    writers.matrix(writers.with_invalid_letter(catalog.substitution_matrix(spark, sf)), path)
    return readers.matrix(spark, path)


@oracle(f"WITH {SEQUENCES} SELECT count(*) AS n_records, 2 * count(*) AS n_lines, CAST(sum(length(seq)) AS BIGINT) AS n_letters FROM sequences")
def fasta_read(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence records dealt over files, none of them cut: the line after a record's name is its whole sequence."""
    path = shared_folder(spark, "fasta")
    writers.fasta(inputs.sequences(spark, sf), path)
    lines = readers.numbered_lines(spark, path)
    return lines.agg(F.count_if(F.col("value").startswith(">")).alias("n_records"), F.count("*").alias("n_lines"), F.sum(F.when(~F.col("value").startswith(">"), F.length("value")).otherwise(0)).alias("n_letters"))


@oracle(f"WITH {SEQUENCES} SELECT sid, seq FROM sequences")
def fasta_records_read(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence records dealt over files and read back whole."""
    path = shared_folder(spark, "fasta")
    writers.fasta(inputs.sequences(spark, sf), path)
    return readers.fasta(spark, path)


@oracle("""WITH g AS (SELECT 'd' || c_custkey AS sid, 'g' || c_nationkey AS group_id FROM customer), o AS (SELECT group_id, row_number() OVER (ORDER BY sha256('42:' || group_id)) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM g))
SELECT sid AS structure_id, group_id, CASE WHEN place <= floor(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM g JOIN o USING (group_id)""")
def split_manifests_read(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "manifests")
    writers.split_manifests(catalog.group_split_hash(spark, sf), path)
    return spark.read.option("header", True).schema("structure_id string, group_id string, split string").csv([f"{path}/train_manifest", f"{path}/val_manifest"])


@oracle("SELECT 'd' || c_custkey AS sid, CASE WHEN fold_id = 1 THEN 'val' ELSE 'train' END AS split FROM (SELECT *, CAST(ntile(4) OVER (ORDER BY sha256('7:' || n_name)) AS INTEGER) AS fold_id FROM nation) JOIN customer ON c_nationkey = n_nationkey")
def fold_lists_read(spark: SparkSession, sf: str) -> DataFrame:
    """Files of ids of each side of an experiment, with a header each, put together without the headers."""
    path = shared_folder(spark, "folds")
    folds = catalog.fold_complements(spark, sf).where("experiment = 1").select("fold", "split")
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("fold"), F.col("n_nationkey").alias("c_nationkey"))
    rows = table(spark, sf, "customer").join(F.broadcast(folds.join(nations, "fold")), "c_nationkey").select(F.concat(F.lit("d"), "c_custkey").alias("NAME"), "split")
    rows.write.partitionBy("split").option("header", True).csv(path)
    side = lambda s: readers.concatenated(spark, f"{path}/split={s}", "^NAME").select(F.col("value").alias("sid"), F.lit(s).alias("split"))
    return side("train").union(side("val"))


@oracle(f"""WITH {ALIGNMENTS}, {CLASSES}, p AS (SELECT sid, string_split(class, '.') AS s FROM classes), lv AS (SELECT sid, CASE WHEN len(s) >= 2 THEN array_to_string(s[1:2], '.') END AS fold, CASE WHEN len(s) >= 3 THEN array_to_string(s[1:3], '.') END AS sf FROM p)
SELECT x.fold AS fold_source, y.sf AS superfamily_target, count(*) AS n, CAST(sum(i) AS BIGINT) AS idx_sum, CAST(sum(CAST(j AS DOUBLE)) AS BIGINT) AS dist_sum
FROM pairs LEFT JOIN lv x ON sid1 = x.sid LEFT JOIN lv y ON sid2 = y.sid GROUP BY 1, 2""")
def pair_metadata_read(spark: SparkSession, sf: str) -> DataFrame:
    """The pair table, written as Parquet and read back by three of its columns."""
    path = f"{shared_folder(spark, 'metadata')}/pair_metadata"
    writers.table(catalog.pair_metadata_join(spark, sf), path)
    rows = spark.read.parquet(path).groupBy("fold_source", "superfamily_target")
    return rows.agg(F.count("*").alias("n"), F.sum("idx_source").alias("idx_sum"), F.sum("ca_dist_superposed").cast("long").alias("dist_sum"))


ERRORS = f"""{ALIGNMENTS}, known AS (SELECT 'd' || s_suppkey AS sid FROM supplier WHERE s_acctbal > 0),
errors AS (SELECT alignment_id, sid1, sid2, cigar, CASE WHEN sid1 NOT IN (SELECT sid FROM known) THEN 'no structure file for ' || sid1 WHEN sid2 NOT IN (SELECT sid FROM known) THEN 'no structure file for ' || sid2 END AS error FROM alignments)"""


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("d"), F.col("s_suppkey")).alias("sid"))
    return dataset.with_errors(inputs.alignments(spark, sf), known)


@oracle(f"WITH {ERRORS} SELECT alignment_id, sid1, sid2, cigar, 'FileNotFoundError' AS error_type, error FROM errors WHERE error IS NOT NULL")
def skipped_read(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments that lack a structure, written as a table of tabs and read back."""
    path = f"{shared_folder(spark, 'skipped')}/skipped.tsv"
    names = ["alignment_id", "sid1", "sid2", "cigar", "error_type", "error"]
    writers.tsv(_errors(spark, sf).where("error is not null").select(*names), [F.col(c) for c in ("sid1", "sid2", "cigar", "alignment_id")], path)
    return spark.read.option("sep", "\t").option("header", True).schema(", ".join(f"{c} string" for c in names)).csv(path)


@oracle(f"WITH {ERRORS} SELECT count(*) AS alignments, count(error) AS errored, count(error) > 0 AS fails_strict, count(error) > 0.01 * count(*) AS fails_share FROM errors")
def fail_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the skipped alignments would end a build, with the strict setting and by their share."""
    counts = _errors(spark, sf).agg(F.count("*").alias("alignments"), F.count("error").alias("errored")).first().asDict()
    row = (counts["alignments"], counts["errored"], dataset.fails(counts, True, 0.01) is not None, dataset.fails(counts, False, 0.01) is not None)
    return spark.createDataFrame([row], "alignments long, errored long, fails_strict boolean, fails_share boolean")


@oracle(f"WITH {ALIGNMENTS}, {SEQUENCES}, known AS (SELECT sid FROM sequences WHERE length(seq) >= 70) SELECT DISTINCT alignment_id, sid1, sid2, cigar FROM alignments WHERE sid1 NOT IN (SELECT sid FROM known) OR sid2 NOT IN (SELECT sid FROM known) ORDER BY sid1, sid2, alignment_id, cigar LIMIT 100")
def missing_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred alignments that lack a sequence; only longer ones are given."""
    return alphabet.missing_sequences(inputs.alignments(spark, sf), inputs.sequences(spark, sf).where("length(seq) >= 70"))


@oracle("""SELECT sid, coalesce(CASE WHEN len(s) >= 3 THEN array_to_string(s[1:3], '.') END, CASE WHEN sid LIKE 'd%' AND length(sid) >= 5 THEN substr(sid, 2, 4) ELSE sid END) AS group_id
FROM (SELECT 'd' || p_partkey AS sid FROM part) LEFT JOIN (WITH """ + CLASSES + """ SELECT sid, string_split(class, '.') AS s FROM classes WHERE CAST(substr(sid, 2) AS BIGINT) % 4 <> 0) USING (sid)""")
def split_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The group of every id: its superfamily, or what its name says where the class is unknown or short."""
    known = inputs.classes(spark, sf).where("cast(substring(sid, 2) as bigint) % 4 <> 0")
    return splits.groups(table(spark, sf, "part").select(F.concat(F.lit("d"), "p_partkey").alias("sid")), known, "superfamily")


@oracle(r"""WITH f AS (SELECT concat('/data/', CASE WHEN p_partkey % 3 = 0 THEN 'd' WHEN p_partkey % 7 = 0 THEN '.d' ELSE 'x' END, p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.pdb' WHEN 1 THEN '.ent' WHEN 2 THEN '.txt' ELSE '' END) AS path, p_size FROM part)
SELECT path, regexp_matches(regexp_extract(path, '([^/]+)$', 1), '^d|\.(pdb|ent)$') AND NOT starts_with(regexp_extract(path, '([^/]+)$', 1), '.') AS domain, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.(pdb|ent)$', '') AS sid, format('{:.1f} MiB', p_size * 1000003 / 1048576.0::DOUBLE) AS size FROM f""")
def file_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Which paths look like structure files, their ids and sizes in words."""
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, "d").when(key % 7 == 0, ".d").otherwise("x")
    ending = F.when(key % 5 == 0, ".pdb").when(key % 5 == 1, ".ent").when(key % 5 == 2, ".txt").otherwise("")
    rows = table(spark, sf, "part").select(F.concat(F.lit("/data/"), name, _s(key), ending).alias("path"), F.col("p_size"))
    return rows.select("path", readers.looks_like_domain("path").alias("domain"), hierarchy.sid_of_path("path").alias("sid"), hierarchy.mebibytes(F.col("p_size").cast("long") * 1000003).alias("size"))


@oracle("SELECT count(*) FILTER (l_linenumber = 7) AS l_quantity, count(*) FILTER (l_partkey % 11 = 0) AS l_tax, count(*) FILTER (l_suppkey % 5 = 0) AS l_discount FROM lineitem")
def nonfinite_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Values that a feature table must not have: null, NaN and infinite ones, by column."""
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("double")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 11 == 0, float("nan")).otherwise(F.col("l_tax").cast("double")).alias("l_tax"),
        F.when(F.col("l_suppkey") % 5 == 0, float("-inf")).otherwise(F.col("l_discount").cast("double")).alias("l_discount"),
    )
    return stats.nonfinite(rows, rows.columns)


@oracle("""SELECT seed, round(fam, 9) AS fam, round(score, 9) AS score FROM (SELECT s_suppkey AS seed, abs(s_acctbal)::DOUBLE / 10000 AS fam, (abs(s_acctbal)::DOUBLE / 10000 / 0.928162::DOUBLE + (s_suppkey % 10) / 10.0::DOUBLE / 0.662063::DOUBLE + (s_nationkey % 4) / 10.0::DOUBLE / 0.275436::DOUBLE) / 3 AS score FROM supplier) ORDER BY score DESC, seed LIMIT 1""")
def best_of_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The run with the best sensitivities over their normalisers."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed"), (F.abs("s_acctbal").cast("double") / 10000).alias("fam"), (F.col("s_suppkey") % 10 / 10.0).alias("sfam"), (F.col("s_nationkey") % 4 / 10.0).alias("fold"))
    return search.best_seed(rows).select("seed", F.round("fam", 9).alias("fam"), F.round("score", 9).alias("score"))


# ---- structure files

#: Residues of a file; a chain's later ones are in further files.
RESIDUES = 500
ATOMS = ("ca", "cb", "n", "c")
_FILES = f"""{CHAINS}, placed AS (SELECT *, 'd' || chain || '_' || (idx // {RESIDUES}) AS sid, idx % {RESIDUES} AS place FROM chains)"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """sid, path, content: the chains as structure files; invalid residues are hetero, each thirteenth lacks its side-chain atom, coordinates have three places."""
    rows = inputs.chains(spark, sf).withColumns({"sid": F.concat(F.lit("d"), _s("chain"), F.lit("_"), _s(F.floor(F.col("idx") / RESIDUES))), "at": F.col("idx") % RESIDUES})

    def line(atom: str) -> Column:
        x = [F.floor(F.col(f"{atom}_{d}") * 1000 + 0.5) / 1000.0 for d in "xyz"]
        kind = F.when(F.col("valid"), "ATOM  ").otherwise("HETATM")
        text = F.format_string("%s%5d  %-3s ALA A%4d    %8.3f%8.3f%8.3f  1.00  0.00\n", kind, F.col("at"), F.lit(atom.upper()), F.col("at"), *x)
        return F.when(F.col("idx") % 13 == 5, "").otherwise(text) if atom == "cb" else text

    lines = rows.select("sid", "at", F.concat(*map(line, ATOMS)).alias("text"))
    files = lines.groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x.text), "").alias("text"))
    return files.select("sid", F.concat(F.lit("/"), "sid").alias("path"), F.col("text").cast("binary").alias("content"))


_thousandths = ", ".join(f"CASE WHEN valid{' AND idx % 13 <> 5' if a == 'cb' else ''} THEN round(floor({a}_{d} * 1000 + 0.5) / 1000.0::DOUBLE, 3) + 0.0 END AS {a}_{d}" for a in ("ca", "n", "c") for d in "xyz")


@oracle(f"WITH {_FILES} SELECT sid, CAST(place AS INTEGER) AS idx, 'ALA' AS resname, NOT valid AS is_het, {_thousandths}, valid FROM placed")
def residues_read(spark: SparkSession, sf: str) -> DataFrame:
    """Residues of structure files by the parser; hetero ones keep their place without coordinates, a missing side-chain atom is placed."""
    rows = readers.residues(_files(spark, sf))
    at = lambda a, k: (F.round(F.get(a, F.lit(k)).cast("double"), 3) + 0.0)
    return rows.select("sid", "idx", "resname", "is_het", *(at(a, k).alias(f"{a}_{d}") for a in ("ca", "n", "c") for k, d in enumerate("xyz")), "valid")


@oracle(f"""WITH {_FILES}, f AS (SELECT sid, count(*) AS n, count(*) FILTER (valid) AS v FROM placed GROUP BY 1)
SELECT sid, CAST(n AS INTEGER) AS n_residues, CAST(v AS INTEGER) AS n_valid_residues, round(v / n::DOUBLE, 9) AS valid_fraction, 1 AS n_chains, 'A' AS selected_chain, v = 0 AS has_missing_ca, v = 0 AS has_missing_backbone, CASE WHEN v > 0 THEN 'ok' ELSE 'no_valid_residues' END AS parse_status FROM f
UNION ALL SELECT 'd' || n_name, 0, 0, 0, 0, NULL, true, true, 'missing_file' FROM nation""")
def structure_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, completeness and status of wanted structures, of which some have no file."""
    files = _files(spark, sf)
    wanted = files.select("sid").union(table(spark, sf, "nation").select(F.concat(F.lit("d"), "n_name")))
    rows = readers.structure_qc(wanted, files)
    return rows.select("sid", "n_residues", "n_valid_residues", F.round("valid_fraction", 9).alias("valid_fraction"), "n_chains", "selected_chain", "has_missing_ca", "has_missing_backbone", "parse_status")


# ---- the encoder

def _numbers(a: np.ndarray) -> str:
    return "[" + ", ".join(_numbers(x) if np.ndim(x) else f"{float(x)!r}::DOUBLE" for x in a) + "]"


def _encoder_sql(net: Mlp) -> str:
    """The network's output as steps over a table x(chain, idx, h), by lists."""
    w, steps, at = list(net.weights), [], 0

    def step(expr: str, *more: str) -> None:
        nonlocal at
        steps.append(f"x{at + 1} AS (SELECT chain, idx, {expr} AS h{''.join(f', {m}' for m in more)} FROM x{at})")
        at += 1

    def linear(more: tuple = ()) -> None:
        a, b = w.pop(0), w.pop(0)
        step(f"list_transform(list_zip({_numbers(a.T)}, {_numbers(b)}), lambda r: list_dot_product(r[1], h) + r[2])", *more)

    def norm(more: tuple = ()) -> None:
        g, b = w.pop(0), w.pop(0)
        step("list_transform(h, lambda v: (v - list_avg(h)) / sqrt(list_avg(list_transform(h, lambda u: (u - list_avg(h)) * (u - list_avg(h)))) + 1e-5))", *more)
        step(f"list_transform(list_zip(h, {_numbers(g)}, {_numbers(b)}), lambda r: r[1] * r[2] + r[3])", *(["s"] if more else []))

    def act(*more: str) -> None:
        step("list_transform(h, lambda v: v / (1 + exp(-greatest(-60, least(60, v)))))", *more)

    linear()
    for _ in range(net.depth):
        norm(("h AS s",))
        act("s")
        linear(("s",))
        act("s")
        linear(("s",))
        step("list_transform(list_zip(h, s), lambda r: r[1] + r[2])")
    norm()
    act()
    linear()
    return ",\n".join(steps) + f",\nz AS (SELECT chain, idx, h[1] AS z1, h[2] AS z2 FROM x{at})"


def encoder_sql() -> str:
    digit = lambda z, n: f"CAST(greatest(0, least({n - 1}, round_even((tanh({z}) + 1.0{'' if n % 2 else f' - 1.0 / {n}'}) / 2.0 * {n - 1}.0, 0))) AS INTEGER)"
    feats = ", ".join(f"CAST(CAST(f{k} AS FLOAT) AS DOUBLE)" for k in range(10))
    whole = " AND ".join(f"f{k} IS NOT NULL" for k in range(7))
    return f"""WITH {DESCRIPTORS}, x0 AS (SELECT chain, idx, [{feats}] AS h FROM descriptors WHERE {whole}),
{_encoder_sql(Model.fresh(seed=3, levels=LEVELS).encoder)}
SELECT chain, idx, {digit("z1", LEVELS[0])} * {LEVELS[1]} + {digit("z2", LEVELS[1])} AS state, substr('{quantize.LETTERS}', {digit("z1", LEVELS[0])} * {LEVELS[1]} + {digit("z2", LEVELS[1])} + 1, 1) AS letter FROM z"""


@oracle(encoder_sql())
def encode_model(spark: SparkSession, sf: str) -> DataFrame:
    """States and letters of every whole descriptor by the encoder with fixed weights."""
    rows = catalog._descriptors(spark, sf).select("chain", "idx", F.array(*(F.col(f"f{k}").cast("float") for k in range(10))).alias("feat"))
    return encode_states(rows, Model.fresh(seed=3, levels=LEVELS)).select("chain", "idx", "state", quantize.letter(F.col("state")).alias("letter"))


@oracle(f"""WITH {CHAINS} SELECT a.chain AS chain1, CASE WHEN count(*) < 3 THEN '{pairs.TOO_FEW}' END AS status, count(*) AS n_pairs
FROM chains a JOIN chains b ON b.chain = a.chain + 1 AND a.idx = b.idx WHERE a.valid AND b.valid AND (a.idx < a.chain OR a.chain > 4) GROUP BY 1""")
def superposition_status(spark: SparkSession, sf: str) -> DataFrame:
    """Which alignments can be superposed: of too few pairs, none."""
    rows = pairs.superposed(catalog._chain_pairs(spark, sf).where("k < chain1 or chain1 > 4"))
    return rows.groupBy("chain1").agg(F.first("status").alias("status"), F.count("*").alias("n_pairs"))


@oracle("""SELECT 'all' AS run, o_orderstatus AS fold, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 2
UNION ALL SELECT 'open', o_orderstatus, count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'O' GROUP BY 2""")
def append_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log that runs append their figures to: a run that is repeated replaces its own rows, so that one copy is left."""
    path, orders = shared_folder(spark, "log"), table(spark, sf, "orders")
    figures = lambda rows: rows.groupBy(F.col("o_orderstatus").alias("fold")).agg(F.count("*").alias("n"), F.sum("o_custkey").cast("long").alias("total"))
    for run, rows in (("all", orders.where("o_custkey % 2 = 0")), ("open", orders.where("o_orderstatus = 'O'")), ("all", orders), ("all", orders)):
        writers.append_run(figures(rows), run, path)
    return spark.read.schema("fold string, n long, total long, run string").parquet(path).select("run", "fold", "n", "total")


# ---- arrays and archives

@oracle(f"""SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, {", ".join(f"embedding[{k + 1}]::DOUBLE + 0.0 AS x{k}" for k in range(catalog.WIDTH))}, embedding[{catalog.WIDTH}]::DOUBLE + 0.0 AS y0 FROM embeddings WHERE embedding IS NOT NULL""")
def array_files_read(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors in order of their ids as the rows of one array file, and turned round as those of another, read together."""
    rows, folder = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", "embedding"), shared_folder(spark, "arrays")
    writers.made_folder(folder)
    order = [F.col("vec_id"), F.col("embedding")]
    arrayfiles.write_array(rows, "embedding", order, f"{folder}/x.npy")
    arrayfiles.write_array(rows.withColumn("turned", F.reverse("embedding")), "turned", order, f"{folder}/y.npy")
    found = arrayfiles.array_rows(spark, {c: f"{folder}/{c}.npy" for c in "xy"})
    return found.select("row", *((F.get("x", F.lit(k)) + 0.0).alias(f"x{k}") for k in range(catalog.WIDTH)), (F.get("y", F.lit(0)) + 0.0).alias("y0"))


@oracle("""SELECT concat(coalesce(lang, 'none'), '/', coalesce(doc_id::VARCHAR, 'none'), '.txt') AS member, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def archive_read(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as members of archives, plain ones and compressed ones, read back by their members."""
    folder = shared_folder(spark, "archives")
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce(_s("doc_id"), F.lit("none")), F.lit(".txt")).alias("member"), F.col("text").cast("binary").alias("content"))
    squeezed = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    archives.write_archives(rows.where(~squeezed), f"{folder}/plain")
    archives.write_archives(rows.where(squeezed), f"{folder}/squeezed", compressed=True)
    return archives.members(spark, f"{folder}/*").select("member", "size", F.sha2("content", 256).alias("sha256"))
