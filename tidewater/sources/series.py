"""Readers and writers of series and parameter files."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.model import RegimeModel, checked_joint, fq_to_cov


def read_csv(spark: SparkSession, path: str, schema: str, ts: str | None = None, ts_format: str | None = None, sep: str = ",") -> DataFrame:
    """A CSV table with a header and an explicit schema; `ts`, read as text, is parsed by `ts_format` (day-first dates too)."""
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).csv(path)
    return rows.withColumn(ts, F.to_timestamp(ts, ts_format) if ts_format else F.to_timestamp(ts)) if ts else rows


def _offset(rows: DataFrame, place: str, across: bool) -> DataFrame:
    """_file, _block, _first (least `place` of a split) and _base: how many rows of its file (or, across, of all files by name) stand in earlier splits."""
    splits = rows.groupBy("_file", "_block").agg(F.min(place).alias("_first"), F.count("*").alias("_rows"))
    w = Window.partitionBy() if across else Window.partitionBy("_file")
    before = F.sum("_rows").over(w.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    return splits.select("_file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_base"))


def numbered(rows: DataFrame, place: str, name: str, across: bool = False) -> DataFrame:
    """Adds `name`, the place of a row among the rows of its file, from `place`, which counts up within a split.

    Only one row for each split is shuffled and joined; no task sees more than its own splits.
    """
    found = _offset(rows, place, across)
    return rows.join(found, ["_file", "_block"]).withColumn(name, F.col(place) - F.col("_first") + F.col("_base")).drop("_first", "_base")


def _lines(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """_file, _block, _line, _n and _kept of the lines that are not blank, of text files whose lines end in LF, CR LF or CR alone.

    _n counts all lines of the file, _kept those that are not blank. A file is read in splits by as many tasks as it
    has: lines are counted within splits, and the splits' counts are summed over the file. With `across` the files of
    the path are one, in the order of their names.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    every = read.withColumn("_all", F.monotonically_increasing_id())
    kept = every.filter(F.trim("value") != "").withColumn("_some", F.monotonically_increasing_id())
    lines = numbered(kept, "_some", "_kept", across)
    lines = lines.join(_offset(every, "_all", across), ["_file", "_block"]).withColumn("_n", F.col("_all") - F.col("_first") + F.col("_base"))
    return lines.select("_file", "_block", F.trim("value").alias("_line"), "_n", "_kept")


def read_csv_after(spark: SparkSession, path: str, schema: str, preamble: int) -> DataFrame:
    """A CSV file with `preamble` lines and a header before its rows."""
    rows = _lines(spark, path).filter(F.col("_n") > preamble)
    return rows.select(F.from_csv("_line", F.lit(schema), {"ignoreLeadingWhiteSpace": "true"}).alias("_row")).select("_row.*")


def read_numbers(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """n, value of a file with one number on each line; blank lines don't count. With `across`, of all files of a folder in the order of their names."""
    return _lines(spark, path, across).select(F.col("_kept").alias("n"), F.col("_line").cast("double").alias("value"))


def read_matrix(spark: SparkSession, path: str, skip: int = 1, sep: str = ",", across: bool = False) -> DataFrame:
    """n, values (array, an empty cell is null) of a text matrix whose first `skip` lines are dropped. With `across`, of one over all files of a folder in the order of their names."""
    lines = _lines(spark, path, across)
    head = lines.filter(F.col("_n") < skip)
    if across:
        rows = lines.filter(F.col("_n") >= skip).crossJoin(F.broadcast(head.agg(F.count("*").alias("_above"))))
    else:
        rows = lines.filter(F.col("_n") >= skip).join(head.groupBy("_file").agg(F.count("*").alias("_above")), "_file", "left")
    values = F.transform(F.split("_line", f"\\s*{sep}\\s*" if sep.strip() else r"\s+"), lambda x: F.when(x != "", x).cast("double"))
    return rows.select((F.col("_kept") - F.coalesce("_above", F.lit(0))).alias("n"), values.alias("values"))


def read_sections(spark: SparkSession, path: str, names: tuple[str, ...] = ("x", "r", "y")) -> DataFrame:
    """n and one column for each section of a dump: lines of numbers between # lines, a matrix with a row for each dimension.

    Sections of one row are doubles, others arrays; n is the place in a row. Works for hard and fuzzy regimes alike.
    A line is a row of one task, as the form has a series in a line; its numbers are spread before they are joined.
    """
    lines = _lines(spark, path).withColumn("_head", F.col("_line").startswith("#"))
    heads = lines.filter("_head").select("_file", "_kept")
    follow = heads.select("_file", (F.col("_kept") - 1).alias("_kept"))
    ends = heads.join(follow, ["_file", "_kept"], "left_anti").groupBy("_file").agg(F.collect_list("_kept").alias("_ends"))
    first = lines.filter("_kept = 0").select("_file", (~F.col("_head")).cast("int").alias("_open"))
    body = lines.filter("NOT _head").join(first, "_file").join(ends, "_file", "left")
    body = body.withColumn("_section", F.col("_open") + F.size(F.filter(F.coalesce("_ends", F.array().cast("array<long>")), lambda e: e < F.col("_kept"))))
    values = body.select("_section", "_kept", F.posexplode(F.split("_line", r"\s+")).alias("n", "_value"))
    lists = values.groupBy("n", "_section").agg(F.sort_array(F.collect_list(F.struct("_kept", F.col("_value").cast("double").alias("v")))).alias("_v"))
    wide = lists.groupBy("n").agg(*(F.first(F.when(F.col("_section") == i + 1, F.transform("_v", lambda z: z["v"])), ignorenulls=True).alias(c) for i, c in enumerate(names)))
    sizes = wide.agg(*(F.max(F.size(c)).alias(c) for c in names)).first()
    return wide.select("n", *((F.get(c, F.lit(0)) if sizes[c] == 1 else F.col(c)).alias(c) for c in names))


def write_sections(df: DataFrame, path: str, order: str, sections: dict[str, str], title: str = "x r y", digits: int = 4) -> None:
    """Writes a table as a dump that read_sections() reads: a section for each title and column, one line of its values by `order`.

    Whole-numbered columns are written as such, others with `digits` decimals. Each line is made on an executor; the
    form has a series in a line, so a line must fit there.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    shown = lambda c: F.col(c).cast("string") if kinds[c] in ("integer", "long", "short", "byte") else F.format_string(f"%.{digits}f", F.col(c).cast("double"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_at"), F.lit(name).alias("_title"), shown(c).alias("_text")) for i, (name, c) in enumerate(sections.items())))).alias("_s")
    lines = df.select(F.col(order).alias("_order"), each).groupBy("_s._at", "_s._title").agg(F.sort_array(F.collect_list(F.struct("_order", "_s._text"))).alias("_row"))
    body = F.concat(F.when(F.col("_at") == 0, F.lit(f"# {title}\n#\n")).otherwise(F.lit("")), F.lit("# "), "_title", F.lit("\n"), F.array_join(F.transform("_row", lambda x: x["_text"]), " "), F.lit("\n"))
    lines.orderBy("_at").select(body.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_numbers(df: DataFrame, path: str, order: str, column: str) -> None:
    """One number on each line, in the order of a column, in as many files as tasks; read_numbers(across=True) reads them as one."""
    df.orderBy(order).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_matrix(df: DataFrame, path: str, order: str, columns: dict[str, str], sep: str = ", ") -> None:
    """A line of names (titles of the columns), then a line for each row in the order of a column, in as many files as tasks; read_matrix(across=True) reads them as one."""
    body = df.select(F.lit(1).alias("_part"), F.col(order).alias("_order"), F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns.values())).alias("value"))
    head = body.sparkSession.createDataFrame([(sep.join(columns),)], "value string").select(F.lit(0).alias("_part"), F.lit(None).cast(body.schema["_order"].dataType).alias("_order"), "value")
    body.unionByName(head).orderBy("_part", "_order").select("value").write.mode("overwrite").text(path)


def sections_text(sections: dict[str, np.ndarray], title: str = "x r y", digits: int = 4) -> str:
    """The text form of a dump that read_sections() reads: whole numbers as such, others with `digits` decimals."""
    parts = [f"# {title}\n#\n"]
    for name, rows in sections.items():
        rows = np.atleast_2d(rows)
        whole = np.issubdtype(rows.dtype, np.integer)
        parts.append(f"# {name}\n" + "\n".join(" ".join(str(int(v)) if whole else f"{v:.{digits}f}" for v in row) for row in rows) + "\n\n")
    return "".join(parts)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, header: bool = True) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", header).csv(path)


def partition_by_key(df: DataFrame, path: str, key: str) -> None:
    """One folder for each value of the key."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def _sections(text: str) -> list[tuple[str, np.ndarray]]:
    """Blocks of numbers with the # lines above them."""
    out, title, rows = [], "", []
    for line in [*text.splitlines(), "#"]:
        line = line.strip()
        if line.startswith("#"):
            if rows:
                out.append((title, np.array(rows, dtype=float)))
                rows, title = [], ""
            title = f"{title} {line.lstrip('#').strip()}".strip().lower()
        elif line:
            if re.fullmatch(r"[0-9a-z]+(:[-0-9.]+)+", line):
                out.append(("law " + line, np.zeros(0)))
            else:
                rows.append([float(x) for x in line.split()])
        elif rows:
            out.append((title, np.array(rows)))
            rows = []
    return out


def read_model(spark: SparkSession, path: str) -> tuple[RegimeModel, str | None]:
    """The model and law string of a parameter file of blocks under # titles (a small file, read on the driver).

    Blocks are covariances of pairs, or transition and noise matrices A and B (Q = B B'); then means and, where given,
    the joint law of regimes (uniform otherwise).
    """
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    found = _sections(text)
    law = next((t[4:] for t, _ in found if t.startswith("law ")), None)
    blocks = [b for t, b in found if b.size and b.ndim == 2]
    square = [b for b in blocks if b.shape[0] == b.shape[1]]
    means = [b for t, b in found if b.size and "mean" in t]
    mean = np.hstack(means[:2])
    k, n = mean.shape
    joint = next((b for t, b in found if "joint" in t or "jump matrix" in t), np.full((k, k), 1 / k**2))
    covs = [b for b in square if b.shape[0] == 2 * n]
    if len(covs) >= k * k:
        cov = np.array(covs[: k * k]).reshape(k, k, 2 * n, 2 * n)
        gamma = cov[range(k), range(k), :n, :n]
        sigma = cov[:, :, :n, n:]
    else:
        ab = [b for b in square if b.shape[0] == n][: 2 * k * k]
        f, b = np.array(ab[: k * k]).reshape(k, k, n, n), np.array(ab[k * k :]).reshape(k, k, n, n)
        gamma = np.array([fq_to_cov(f[j, j], b[j, j] @ b[j, j].T)[0] for j in range(k)])
        sigma = np.einsum("jab,jkcb->jkac", gamma, f)
    return RegimeModel(mean, gamma, sigma, checked_joint(joint), means[0].shape[1]), law


def law_of(spark: SparkSession, path: str, text: str = "-1") -> str:
    """A law string as given, or for "-1" the one in a parameter file."""
    if text != "-1":
        return text
    _, law = read_model(spark, path)
    if law is None:
        raise ValueError(f"{path} has no law")
    return law


def cells_of(spark: SparkSession, path: str, cells: int = -1) -> int:
    """A number of cells as given, or for -1 the one in a parameter file."""
    if cells != -1:
        return cells
    named = re.search(r"(?im)^#?\s*(?:cells|steps)\D*(\d+)", "\n".join(r[0] for r in spark.read.text(path).collect()))
    if not named:
        raise ValueError(f"{path} has no number of cells")
    return int(named[1])


def model_text(model: RegimeModel, law: str | None = None) -> str:
    """The text form of a model that read_model() reads."""
    show = lambda m: "\n".join(" ".join(repr(float(x)) for x in row) for row in np.atleast_2d(m))
    k = len(model.mean)
    parts = [f"# Cov {i} {j}\n{show(model.pair_cov(i, j))}" for i in range(k) for j in range(k)]
    parts += [f"# mean of X\n{show(model.mean[:, : model.n_x])}", f"# mean of Y\n{show(model.mean[:, model.n_x :])}", f"# joint jump matrix\n{show(model.joint)}"]
    return "\n".join([*parts, *([f"# fuzzy parameters\n{law}"] if law else []), ""])


def corners_text(model: RegimeModel, law: str, cells: int) -> str:
    """The text form of a fuzzy model by its four corners, to be interpolated: law string, cells, covariances of the hard pairs and means."""
    show = lambda m: "\n".join(" ".join(f"{float(x):.4f}" for x in row) for row in np.atleast_2d(m))
    parts = [f"# fuzzy parameters\n{law}\n# cells {cells}"]
    parts += [f"# Cov {i} {j}\n{show(model.pair_cov(i, j))}" for i in (0, -1) for j in (0, -1)]
    ends = [0, len(model.mean) - 1]
    return "\n".join([*parts, f"# mean of X\n{show(model.mean[ends, : model.n_x])}", f"# mean of Y\n{show(model.mean[ends, model.n_x :])}", ""])


def regression_text(m: np.ndarray, lambda2: np.ndarray, p: np.ndarray, pi2: np.ndarray, law: str) -> str:
    """The text form of regressions of all pairs: law string, then M, Lambda2, P and Pi2 of each pair in a line of its own."""
    parts = [f"# fuzzy parameters\n{law}"]
    for name, value in (("M", m), ("Lambda2", lambda2), ("P", p), ("Pi2", pi2)):
        rows = value.reshape(value.shape[0] * value.shape[1], -1)
        parts.append(f"# {name}\n" + "\n".join(" ".join(f"{float(x):.4f}" for x in row) for row in rows))
    return "\n".join([*parts, ""])


def read_regression(spark: SparkSession, path: str) -> tuple[str | None, dict[str, np.ndarray]]:
    """Law string and the arrays of regression_text(), by pair."""
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    found = _sections(text)
    law = next((t[4:] for t, _ in found if t.startswith("law ")), None)
    out = {}
    for name in ("m", "lambda2", "p", "pi2"):
        rows = next(b for t, b in found if t.split(" ")[-1] == name)
        k = round(len(rows) ** 0.5)
        out[name] = rows.reshape(k, k, -1)
    return law, {n: v[..., 0] if n in ("lambda2", "pi2") else v for n, v in out.items()}


def latex_matrix(m: np.ndarray, digits: int = 2) -> str:
    rows = " \\\\ ".join(" & ".join(f"{float(x):.{digits}f}" for x in row) for row in np.atleast_2d(m))
    return f"\\begin{{pmatrix}} {rows} \\end{{pmatrix}}"


def plain_matrix(m: np.ndarray, digits: int = 4) -> str:
    return "\n".join(" ".join(f"{float(x):.{digits}f}" for x in row) for row in np.atleast_2d(m))
