"""Dataset references of a corpus of pipeline scripts (R1) with database
variables resolved (M12): what each SQL block reads and what each script writes
(views and tables). Table level only; it stands in for the model's lineage
extraction where a deterministic answer is wanted.

A script becomes a table of tokens (one pattern, comments left out), and every
question is one about neighbouring rows: brackets are running sums, statements
running counts, a call is a name between a dot and a bracket, a table is the name
after FROM. Variables are looked up among the script's own assignments before the
statement; the names of WITH queries leave by an anti join. Built-in functions and
windows throughout, with the script as the key, so texts of any length are read
alike and scripts are spread over the cluster; what meets in one task is the
tokens of one script. Keys of scripts must differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import cut_lineage, parts_for

# ---------------------------------------------------------------- token patterns (Java)

_QUOTED = r'''"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'?'''
PYTHON = (r'#[^\n]*|[A-Za-z]{0,2}(?:"{3}(?s:.*?)(?:"{3}|\z)|' + r"'{3}(?s:.*?)(?:'{3}|\z)|" + _QUOTED
          + r")|[A-Za-z_]\w*+|\\\n|\n|[^\s]")
_PART = r"`[^`]*`|\{\w+\}"
SQL = (r"""--[^\n]*|/\*(?s:.*?)(?:\*/|\z)|'[^'\\]*+(?:(?:\\(?s:.)|'')[^'\\]*+)*+'?|"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"?"""
       + rf"|(?:{_PART}|[A-Za-z_]\w*+)(?:\s*+\.\s*+(?:{_PART}|\w++))*+|[^\s]")

# functions whose arguments may hold a FROM that names no table
_FROM_FUNCTIONS = ("EXTRACT", "TRIM", "SUBSTRING", "SUBSTR", "POSITION", "OVERLAY")
# words that end a list of tables
_END_OF_FROM = ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "EXCEPT", "INTERSECT", "MINUS", "SELECT", "WINDOW",
                "QUALIFY", "SET", "CLUSTER", "DISTRIBUTE", "SORT", "WHEN")
# words that stand where a table could, and name none
_NO_TABLE = (*_END_OF_FROM, "VALUES", "LATERAL", "JOIN", "ON", "USING", "TABLE", "ONLY")
_WRITERS = ("createOrReplaceTempView", "createTempView", "createOrReplaceGlobalTempView", "createGlobalTempView",
            "saveAsTable", "insertInto")
#: Words that may stand between CREATE or INSERT and the name, at most.
_AHEAD = 9


def _tokens(df: DataFrame, text: str, pattern: str, drop: str, by: list[str], parts: int | None) -> DataFrame:
    """``df`` without its text, a row per token (pos, t) that does not begin like ``drop``.
    With ``parts`` the texts, as lists of tokens, are dealt by ``by`` to that many tasks
    first: windows sort all tokens of a task, so tasks must grow in number with the texts."""
    found = F.filter(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda x: ~x.rlike(f"^(?:{drop})"))
    rest = [c for c in df.columns if c != text]
    listed = df.select(*rest, found.alias("__tokens"))
    if parts is not None:
        listed = listed.repartition(parts, *by)
    return listed.select(*rest, F.posexplode("__tokens").alias("pos", "t"))


def _depth(tokens: DataFrame, by: list[str], opening: str, closing: str) -> DataFrame:
    """Plus ``depth``: brackets open after a token; a closing one too many counts for nothing."""
    w = Window.partitionBy(*by).orderBy("pos")
    step = F.when(F.col("t").isin(*opening), 1).when(F.col("t").isin(*closing), -1).otherwise(0)
    level = F.sum(step).over(w)
    return (tokens.withColumn("__level", level).withColumn("__least", F.min("__level").over(w))
                  .withColumn("depth", F.col("__level") - F.least(F.lit(0), F.col("__least"))).drop("__level", "__least"))


# ---------------------------------------------------------------- Python scripts

def _literal(t: Column) -> Column:
    """The characters of a string literal; NULL for other tokens."""
    body = F.regexp_replace(t, "^[A-Za-z]{0,2}", "")
    quote = F.when(F.left(body, F.lit(3)).isin('"""', "'''"), F.left(body, F.lit(3))).otherwise(F.left(body, F.lit(1)))
    n = F.length(quote)
    closed = F.endswith(body, quote) & (F.length(body) >= 2 * n)
    return F.when(t.rlike("^[A-Za-z]{0,2}[\"']"),
                  F.substring(body, n + 1, F.length(body) - F.when(closed, 2 * n).otherwise(n)))


def _statements(scripts: DataFrame, key: str) -> DataFrame:
    """Tokens of Python scripts with their statement: (key, stmt, pos, t, text of a
    literal, is_name, neighbours in the statement, assigned variable)."""
    tokens = _tokens(scripts.select(key, "text"), "text", PYTHON, r"#|\\\n", [key], parts_for(scripts))
    t = _depth(tokens, [key], "([{", ")]}")
    ends = (F.col("depth") == 0) & F.col("t").isin("\n", ";")
    t = (t.withColumn("__end", ends).withColumn("stmt", F.sum(F.col("__end").cast("int")).over(Window.partitionBy(key).orderBy("pos")))
          .where(~F.col("__end") & (F.col("t") != "\n")).drop("__end", "depth"))
    w = Window.partitionBy(key, "stmt").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({"literal": _literal(F.col("t")), "i": F.row_number().over(w), "n": F.count("*").over(whole),
                       "before": F.lag("t").over(w), "before2": F.lag("t", 2).over(w),
                       "after": F.lead("t").over(w), "after2": F.lead("t", 2).over(w)})
    t = t.withColumns({"is_name": F.col("literal").isNull() & F.col("t").rlike("^[A-Za-z_]"),
                       "argument": F.when(F.col("after") == "(", F.lead("literal", 2).over(w)),
                       "third": F.nth_value("literal", 3).over(whole)})
    target = (F.col("i") == 1) & F.col("is_name") & (F.col("after") == "=") & (F.coalesce("after2", F.lit("")) != "=")
    return t.withColumn("assigned", F.max(F.when(target, F.col("t"))).over(whole))


def _python_calls(scripts: DataFrame, key: str) -> DataFrame:
    """(key, stmt, call, value, block, vars): calls of spark.sql, spark.table and the
    writers with a literal, and the script's assignments (stmt, name, value)."""
    t = _statements(scripts, key)
    call = F.col("is_name") & (F.col("before") == ".") & F.col("argument").isNotNull()
    starts = call & F.col("t").isin("sql", "table") & (F.col("before2") == "spark")
    inside = Window.partitionBy(key, "stmt").orderBy("pos")
    is_text = (F.col("n") == 3) & F.col("assigned").isNotNull() & F.col("third").isNotNull()
    source = F.when(F.col("is_name") & (F.col("assigned").isNull() | (F.col("i") > 2)), F.struct("i", "t"))
    t = t.withColumns({"starts": F.coalesce(starts, F.lit(False)), "writes": F.coalesce(call & F.col("t").isin(*_WRITERS), F.lit(False))})
    t = t.withColumn("block", F.sum(F.col("starts").cast("int")).over(Window.partitionBy(key).orderBy("pos")).cast("int"))
    t = t.withColumn("own", F.max(F.when(F.col("starts"), F.col("block"))).over(inside))
    # statements in order: the block that a variable was last assigned from goes along
    per = (t.groupBy(key, "stmt").agg(F.first("assigned").alias("name"), F.min(source)["t"].alias("source"), F.max("own").alias("own"),
                                      F.first(is_text).alias("is_text"), F.first("third").alias("third"),
                                      F.max("writes").alias("writes"))
            .where("name IS NOT NULL OR writes"))
    one = F.struct("stmt", F.when(~F.col("is_text"), F.col("name")).alias("name"), "source", "own")
    value = F.struct("stmt", "name", F.when(F.col("is_text"), F.col("third")).alias("value"))
    told = per.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("order"),
                                F.collect_list(F.when(F.col("name").isNotNull(), value)).alias("vars"))
    nothing = F.struct(F.expr("CAST(map() AS MAP<STRING, INT>)").alias("of"),
                       F.expr("CAST(map() AS MAP<BIGINT, INT>)").alias("at"))

    def follow(held, s):
        block = F.try_element_at(held["of"], s["source"])
        now = F.coalesce(s["own"], block)
        others = F.map_filter(held["of"], lambda k, _: k != s["name"])
        of = F.when(s["name"].isNull(), held["of"]).when(now.isNull(), others).otherwise(F.map_concat(others, F.create_map(s["name"], now)))
        at = F.when(block.isNull(), held["at"]).otherwise(F.map_concat(held["at"], F.create_map(s["stmt"], block)))
        return F.struct(of.alias("of"), at.alias("at"))

    told = told.select(key, "vars", F.aggregate("order", nothing, follow)["at"].alias("at"))
    calls = (t.where("starts OR writes").select(
                F.col(key).alias("__k"), "stmt", F.when(F.col("starts"), F.col("t")).otherwise("write").alias("call"),
                F.col("argument").alias("value"), "block", "own")
             .join(told, F.col("__k").eqNullSafe(F.col(key)), "left")
             .withColumn("block", F.when(F.col("call") != "write", F.col("block")).otherwise(
                 F.coalesce("own", F.try_element_at("at", F.col("stmt"))))))
    return calls.select(F.col("__k").alias(key), "stmt", "call", "value", "block", "vars")


def _resolved(name: Column, variables: Column | None, stmt: Column | None) -> Column:
    """A dotted name with variables replaced and quotes dropped; a variable has the
    value of its last assignment before the statement, if that was a literal."""
    def part(p: Column) -> Column:
        plain = F.trim(p, F.lit("`"))
        if variables is None:
            return plain
        known = F.filter(variables, lambda v: (v["name"] == F.substring(p, F.lit(2), F.length(p) - 2)) & (v["stmt"] < stmt))
        last = F.array_max(F.transform(known, lambda v: F.struct(v["stmt"], v["value"])))["value"]
        return F.when(p.startswith("{"), F.coalesce(last, p)).otherwise(plain)

    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(_PART + r"|\w+"), F.lit(0)), part), ".")


# ---------------------------------------------------------------- SQL texts

def _ahead(after: Column, start: Column, words: tuple[str, ...]) -> Column:
    """1-based place of the first of the following tokens from ``start`` on that is none of ``words``."""
    hits = F.transform(after, lambda x, i: (i + 1 >= start) & ~F.coalesce(x["w"], F.lit("")).isin(*words))
    return F.array_position(hits, True).cast("int")


def sql_tables(texts: DataFrame, by: list[str], text: str = "sql", split: bool = False, parts: int | None = None) -> DataFrame:
    """(by, [part], pos, role, name): the tables that SQL texts read and write, names
    as written. Names of a text's WITH queries are none. With ``split`` the statements
    of a text are judged each by itself and numbered in ``part``. ``parts``: see ``_tokens``."""
    t = _tokens(texts.select(*by, text), text, SQL, r"--|/\*|'|\"", by, parts)
    if split:
        ends = F.col("t") == ";"
        t = t.withColumn("__n", F.sum(ends.cast("int")).over(Window.partitionBy(*by).orderBy("pos"))).where(~ends)
        t = t.withColumn("part", F.dense_rank().over(Window.partitionBy(*by).orderBy("__n"))).drop("__n")
        by = [*by, "part"]
    t = t.withColumn("is_name", F.col("t").rlike(rf"^(?:{_PART}|[A-Za-z_])"))
    t = t.withColumn("w", F.when(F.col("is_name"), F.upper("t")).otherwise(F.col("t")))
    t = _depth(t, by, "(", ")")
    w = Window.partitionBy(*by).orderBy("pos")
    t = t.withColumns({
        "before": F.coalesce(F.lag("w").over(w), F.lit("")), "before2": F.coalesce(F.lag("w", 2).over(w), F.lit("")),
        "after": F.array(*(F.lead(F.struct("is_name", "t", "w"), k).over(w) for k in range(1, _AHEAD + 1))),
        "merging": F.coalesce(F.max(F.col("w") == "MERGE").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))})
    level = Window.partitionBy(*by, "depth").orderBy("pos")
    opens = F.col("t") == "("
    t = t.withColumns({"bracket": F.last(F.when(opens, F.col("pos")), ignorenulls=True).over(level),
                       "opener": F.coalesce(F.last(F.when(opens, F.col("before")), ignorenulls=True).over(level), F.lit(""))})

    def word(k):
        return F.coalesce(F.col("after")[k]["w"], F.lit(""))

    names_table = (F.col("w") == "JOIN") | ((F.col("w") == "FROM") & ~F.col("opener").isin(*_FROM_FUNCTIONS)
                                            & ~((F.col("before") == "DISTINCT") & F.col("before2").isin("IS", "NOT")))
    ends_list = F.col("w").isin(*_END_OF_FROM) | ((F.col("w") == "LATERAL") & (word(0) == "VIEW"))
    in_list = F.last(F.when(names_table, True).when(ends_list, False), ignorenulls=True).over(
        Window.partitionBy(*by, "depth", "bracket").orderBy("pos"))
    t = t.withColumn("in_list", F.coalesce(in_list, F.lit(False)))

    after, w0 = F.col("after"), F.col("w")
    made = _ahead(after, F.lit(1), ("OR", "REPLACE", "GLOBAL", "TEMP", "TEMPORARY", "EXTERNAL"))
    makes = (w0 == "CREATE") & F.coalesce(F.try_element_at(after, F.nullif(made, F.lit(0)))["w"].isin("VIEW", "TABLE"), F.lit(False))
    read = ((w0 == ",") & F.col("in_list")) | (names_table & ~((w0 == "FROM") & (F.col("before") == "DELETE"))) | (
        (w0 == "USING") & F.col("merging") & (word(0) != "("))
    updated = (w0 == "UPDATE") & F.array_contains(F.array(word(1), word(2), word(3)), "SET")
    at = (F.when(read | names_table | updated, F.lit(1))
          .when((w0 == "INSERT") & word(0).isin("INTO", "OVERWRITE"), _ahead(after, F.lit(1), ("INTO", "OVERWRITE", "TABLE")))
          .when(makes, _ahead(after, made + 1, ("IF", "NOT", "EXISTS")))
          .when((w0 == "MERGE") & (word(0) == "INTO"), F.lit(2)))
    this, then = (F.try_element_at(after, F.nullif(at, F.lit(0)) + k) for k in (0, 1))
    t = t.withColumns({"role": F.when(read, "read").otherwise("write"), "this": this, "then": then})
    is_table = F.col("this.is_name") & ~F.col("this.w").isin(*_NO_TABLE) & (F.coalesce("then.w", F.lit("")) != "(")
    found = t.where(is_table).select(*by, "pos", "role", F.col("this.t").alias("name"))

    cte = F.when(word(0) == "RECURSIVE", F.lit(2)).otherwise(F.lit(1))
    next_, one, two = (F.coalesce(F.try_element_at(after, cte + k)["w"], F.lit("")) for k in (0, 1, 2))
    named = ((w0 == "WITH") | ((w0 == ",") & ~F.col("in_list"))) & F.try_element_at(after, cte)["is_name"] & (next_ != "") & (
        ((one == "AS") & (two == "(")) | ((one == "(") & (w0 == "WITH")))
    ctes = t.where(named).select(*(F.col(c).alias(f"__{c}") for c in by), F.lower(F.try_element_at(after, cte)["t"]).alias("__name")).distinct()
    same = F.lower("name") == F.col("__name")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return found.join(ctes, same, "left_anti")


# ---------------------------------------------------------------- scripts

def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """Whole scripts (.py, .sql, .txt) under ``path`` as (script_id, text, kind)."""
    # text()'s own wholetext=False default would override an option()
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.{py,sql,txt}", recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    return df.select(name.alias("script_id"), F.col("value").alias("text"),
                     F.substring_index(name, ".", -1).alias("kind"))


def script_references(scripts: DataFrame, key: str = "script_id") -> DataFrame:
    """(key, role, block_no, dataset) with role ``read`` or ``write``.

    In a Python script each ``spark.sql`` or ``spark.table`` call with a literal is
    a block, numbered from 1; a write belongs to the block that its data frame was
    last assigned from (NULL if none). The statements of a SQL file are its blocks.
    A column ``kind`` tells py, sql and txt apart (py without one); a txt file is a
    Python one if it mentions ``spark.``.
    """
    files = None
    if "kind" in scripts.columns:
        is_python = (F.coalesce("kind", F.lit("py")) == "py") | ((F.col("kind") == "txt") & F.col("text").contains("spark."))
        files, scripts = scripts.where(~is_python), scripts.where(is_python)
    parts = parts_for(scripts)
    calls = cut_lineage(_python_calls(scripts.select(key, "text"), key))      # a few rows a script, read three times
    dataset = _resolved(F.col("value"), F.col("vars"), F.col("stmt"))
    role = F.when(F.col("call") == "write", "write").otherwise("read")
    direct = calls.where("call <> 'sql'").select(key, role.alias("role"), F.col("block").alias("block_no"), dataset.alias("dataset"))
    # what a name means is looked up where the text stands, so the names go back to their call
    queries = calls.where("call = 'sql'").select(key, "block", "stmt", "vars", F.col("value").alias("sql"))
    tables = sql_tables(queries, [key, "block"], parts=parts).withColumnRenamed(key, "__k").withColumnRenamed("block", "__b")
    told = queries.select(key, "block", "stmt", "vars")
    used = tables.join(told, F.col("__k").eqNullSafe(F.col(key)) & (F.col("__b") == F.col("block")))
    out = direct.unionByName(used.select(key, "role", F.col("block").alias("block_no"),
                                         _resolved(F.col("name"), F.col("vars"), F.col("stmt")).alias("dataset")))
    if files is None:
        return out
    plain = sql_tables(files.select(key, "text"), [key], "text", split=True, parts=parts)
    return out.unionByName(plain.select(key, "role", F.col("part").cast("int").alias("block_no"),
                                        _resolved(F.col("name"), None, None).alias("dataset")))
