"""Table files (PDFs, spectra, structure functions), parameters, catalogues, dumps and sink dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import MARKER, column_of, file_kind, format_header, parse_series  # noqa: F401

#: The columns of a sink dump.
SINK_COLUMNS = ["part_tag", "time", "posx", "posy", "posz", "velx", "vely", "velz", "accelx", "accely", "accelz", "anglx", "angly", "anglz", "mass", "mdot", "ptime"]
KINDS = {bool: "bool", int: "int", float: "real", str: "str"}


def table_lines(table: DataFrame, file: str, order: str, names: list[str], head: list[str]) -> DataFrame:
    """file, line_no, value: a table's text, with head lines and a line of names before its rows, which are numbered by order."""
    before = len(head) + 1
    rows = table.select(file, (F.col(order) + before).cast("long").alias("line_no"), F.concat(*(F.format_string(" %23.16E", F.col(c).cast("double")) for c in names)).alias("value"))
    top = F.posexplode(F.array(*(F.lit(h) for h in [*head, format_header(names)]))).alias("line_no", "value")
    return rows.unionByName(table.select(file).distinct().select(file, top).withColumn("line_no", F.col("line_no").cast("long")))


def parse_table(lines: DataFrame, names: list[str], head: int, key: tuple[str, ...] = ("file",)) -> DataFrame:
    """key, line_no and a double column for each name of table files, without the head lines and lines that are not numbers."""
    return parse_series(lines.where(F.col("line_no") >= head), names, key=key)


def header_values(lines: DataFrame, key: tuple[str, ...] = ("file",)) -> DataFrame:
    """key, name, value of head lines such as ``mean = 1.0``."""
    found = r"^\s*#?\s*([A-Za-z_]+)\s*[=:]\s*(\S+)\s*$"
    rows = lines.where(F.col("value").rlike(found))
    return rows.select(*key, F.regexp_extract("value", found, 1).alias("name"), F.regexp_extract("value", found, 2).try_cast("double").alias("value"))


def parameters(spark: SparkSession, values: dict) -> DataFrame:
    """name, kind, i, d, b, s: parameters by their type."""
    rows = [(n, KINDS[type(v)], v if type(v) is int else None, v if type(v) is float else None, v if type(v) is bool else None, v.strip() if type(v) is str else None) for n, v in values.items()]
    return spark.createDataFrame(rows, "name string, kind string, i bigint, d double, b boolean, s string")


def parse_parameters(lines: DataFrame, text: str = "value", order: str = "line_no") -> DataFrame:
    """name, kind, i, d, b, s of the lines ``name = value`` of a parameter file, by the look of the value; of one name the last line counts.

    Names are lower-cased. A value is .true. or .false., in quotes, a whole number, another number, or else a string; # begins a comment
    (not in quotes).
    """
    found = r"""^\s*([A-Za-z]\w*)\s*=\s*("[^"]*"|'[^']*'|[^#"'\s][^#]*?)\s*(?:#.*)?$"""
    rows = lines.where(F.col(text).rlike(found)).select(F.lower(F.regexp_extract(text, found, 1)).alias("name"), F.regexp_extract(text, found, 2).alias("v"), order)
    rows = rows.groupBy("name").agg(F.max_by("v", order).alias("v"))
    quoted, low = F.col("v").rlike("""^["']"""), F.lower("v")
    flag = low.isin(".true.", ".false.") & ~quoted
    whole, number = F.col("v").try_cast("bigint"), F.regexp_replace(low, "d", "e").try_cast("double")
    is_whole, is_number = F.col("v").rlike(r"^[+-]?[0-9]+$") & whole.isNotNull(), F.col("v").rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eEdD][+-]?[0-9]+)?$") & number.isNotNull()
    kind = F.when(flag, "bool").when(is_whole, "int").when(is_number, "real").otherwise("str")
    rows = rows.withColumn("kind", kind)
    of = lambda k, c: F.when(F.col("kind") == k, c)
    text_ = F.when(quoted, F.trim(F.substring("v", F.lit(2), F.length("v") - 2))).otherwise(F.col("v"))
    return rows.select("name", "kind", of("int", whole).alias("i"), of("real", number).alias("d"), of("bool", low == ".true.").alias("b"), of("str", text_).alias("s"))


def overwritten(params: DataFrame, values: dict) -> DataFrame:
    """params with new values of some names; their types stay, and unknown names are an error."""
    new = parameters(params.sparkSession, values)
    if new.join(params, ["name", "kind"], "left_anti").limit(1).count():
        raise ValueError("a parameter is not there or has another type")
    return params.join(F.broadcast(new.select("name")), "name", "left_anti").unionByName(new)  # rows that the caller listed


def as_text(params: DataFrame) -> DataFrame:
    """name, kind, value of parameters, as text."""
    return params.select("name", "kind", F.coalesce(F.col("i").cast("string"), F.col("d").cast("string"), F.col("b").cast("string"), F.col("s")).alias("value"))


def grid_kind(params: DataFrame, extracted: bool) -> DataFrame:
    """One row: grid_type (E for an extracted cube, A for adaptive, U for uniform), boundary, ndim."""
    get = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    kind = F.lit("E") if extracted else F.when(get("lrefine_max", "i").isNotNull(), "A").otherwise("U")
    return params.agg(kind.alias("grid_type"), get("xl_boundary_type", "s").alias("boundary"), get("dimensionality", "i").cast("int").alias("ndim"))


def variables(cells: DataFrame, index: tuple[str, ...] = ("block", "i", "j", "k")) -> list[str]:
    """The variables of a mesh table."""
    return [c for c in cells.columns if c not in index]


def renamed(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """cells with variables under other names."""
    return cells.withColumnsRenamed(names)


def with_name(names: list[str], name: str) -> list[str]:
    """A catalogue with a name, once."""
    return names if name in names else [*names, name]


def dump_summary(particles: DataFrame) -> DataFrame:
    """dump, time, sinks, mass, max_mass of each dump of particles."""
    return particles.groupBy("dump").agg(F.max("time").alias("time"), F.count("*").alias("sinks"), F.sum("mass").alias("mass"), F.max("mass").alias("max_mass"))


def paired_files(paths: DataFrame) -> DataFrame:
    """plt, part: plot files with the particle file of the same run and number."""
    rows = paths.select("path", file_kind(F.col("path")).alias("kind"), F.regexp_extract("path", "^(.*)_hdf5_", 1).alias("run"), F.regexp_extract("path", "([0-9]{4})$", 1).alias("n"))
    plt = rows.where("kind = 'plt'").select(F.col("path").alias("plt"), "run", "n")
    return plt.join(rows.where("kind = 'part'").select(F.col("path").alias("part"), "run", "n"), ["run", "n"]).select("plt", "part")


def sink_lines(rows: DataFrame) -> DataFrame:
    """rows with value: their line in a sink dump."""
    numbers = F.concat(*(F.format_string(" %23.16E", F.col(c).cast("double")) for c in SINK_COLUMNS[1:]))
    return rows.withColumn("value", F.concat(F.format_string("%12d", F.col("part_tag").cast("long")), numbers))


def parse_sinks(lines: DataFrame) -> DataFrame:
    """The rows of a sink dump; part_tag is a whole number."""
    out = parse_series(lines.select("line_no", "value"), SINK_COLUMNS)
    return out.withColumn("part_tag", F.col("part_tag").cast("long")).drop("line_no")
