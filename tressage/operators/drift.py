"""Schemas that drift between files: one schema a file, one promoted schema, and the ordered list of changes.

1. *Header read.*  The schema of each file, as paths with the set of scalar types found there, is read from its
   records in parallel; a task reduces what it reads to one row a file and path before anything is shuffled.
2. *Lattice.*  Types are bits (text, number, boolean, and whether a number is no 64-bit integer, and whether a record
   holds several values); schemas fold by bitwise or, and a set of types promotes to the least type that holds them
   all: boolean and bigint < double < string for any mixture, and each of them < an array of it.
3. *Differences.*  Each file's schema meets that of the file before it in its stream by a grouping on (stream,
   sequence, path), each schema row playing the later and the earlier part; no self join.
4. *Renames.*  Only for paths gone and new under the same object, the values of notices that both files deliver are
   compared.  The files' lists of such paths go to the records, so no payload moves; what moves are those values.
5. *Cast.*  :func:`unified` gives every record one struct of typed columns, the union schema under the newest names.

Defined results: a record that is not complete JSON, or null, has no paths, but its file still exists; null values
are absent; an empty string is a text.  The first file of a stream, and one whose predecessor is missing, have no
changes.  A path that several new ones match is listed once for each.  Null streams and sequence numbers are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonwalk import NUMBER, PathNode, scalar_type, triples
from ..runtime import Scratch, hot_keys, python_rows, skew_join

#: Beside TEXT, NUMBER and BOOLEAN: a number that is no 64-bit integer, and several values in one record.
FRACTION, MANY, TYPES = 8, 16, 7
#: The files' lists of paths go to the records by broadcast if they hold at most so many paths (some tens of bytes
#: each), counted first; beyond that by a join on the file that leaves the records of large files in place.
BROADCAST_PATHS = 100_000
#: The most columns :func:`unified` makes; a wider union is refused, and :func:`union_schema` lists it.
MOST_COLUMNS = 20_000


def _narrow(df: DataFrame, file: str, stream: str, seq: str, key: str, payload: str) -> DataFrame:
    rows = df.select(F.col(f"`{file}`").cast("string").alias("_f"), F.col(f"`{stream}`").cast("long").alias("_st"), F.col(f"`{seq}`").cast("long").alias("_sq"), F.col(f"`{key}`").cast("string").alias("_k"), F.col(f"`{payload}`").cast("string").alias("_p"))
    return rows.where(F.col("_st").isNotNull() & F.col("_sq").isNotNull())


def _is_integer(v: str) -> bool:
    return len(v) < 20 and v.lstrip("-").isdigit() and -(1 << 63) <= int(v) < 1 << 63


def file_schemas(rows: DataFrame) -> DataFrame:
    """(_f, _st, _sq, path, types) of each file; a row with a null path for each file, so that none is missed."""
    root: list[PathNode] = []

    def kernel(cols):
        if not root:
            root.append(PathNode())
        seen: dict = {}
        for f, st, sq, text in zip(cols["_f"], cols["_st"], cols["_sq"], cols["_p"]):
            types = seen.setdefault((f, st, sq), {None: 0})
            met = set()
            for node, v, _ in triples(text, root[0]) or ():
                if v is None:
                    continue
                t = scalar_type(v)
                if t == NUMBER and not _is_integer(v):
                    t |= FRACTION
                if node in met:
                    t |= MANY
                met.add(node)
                types[node] = types.get(node, 0) | t
        flat = [(f, st, sq, node and node.text, t) for (f, st, sq), types in seen.items() for node, t in types.items()]
        return dict(zip(("_f", "_st", "_sq", "path", "types"), map(list, zip(*flat)))) if flat else {c: [] for c in ("_f", "_st", "_sq", "path", "types")}

    found = python_rows(rows.select("_f", "_st", "_sq", "_p"), kernel, "_f string, _st long, _sq long, path string, types int")
    return found.groupBy("_f", "_st", "_sq", "path").agg(F.bit_or("types").alias("types"))


def promoted(types: Column) -> Column:
    """The least type of the lattice that holds a set of types."""
    kinds = types.bitwiseAND(TYPES)
    one = F.when(kinds == 0, F.lit("void")).when(kinds == 4, F.lit("boolean")).when(kinds != 2, F.lit("string")).when(types.bitwiseAND(FRACTION) > 0, F.lit("double")).otherwise(F.lit("bigint"))
    return F.when(types.bitwiseAND(MANY) > 0, F.concat(F.lit("array<"), one, F.lit(">"))).otherwise(one)


def type_names(types: Column) -> Column:
    return F.concat_ws(",", *[F.when(types.bitwiseAND(b) > 0, F.lit(n)) for b, n in ((4, "boolean"), (2, "number"), (1, "text"))])


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|\.)[^.]*$", "")


def _differences(schemas: DataFrame) -> DataFrame:
    """(_st, _sq, _f, path, now, before) for each file with a predecessor and each path in either; absent is null."""
    schemas = schemas.withColumn("types", F.col("types").bitwiseAND(TYPES))
    part = F.explode(F.array(F.struct(F.col("_sq").alias("sq"), F.col("types").alias("now"), F.lit(None).cast("int").alias("before"), F.col("_f").alias("f")), F.struct((F.col("_sq") + 1).alias("sq"), F.lit(None).cast("int").alias("now"), F.col("types").alias("before"), F.lit(None).cast("string").alias("f")))).alias("x")
    both = schemas.select("_st", "path", part).select("_st", F.col("x.sq").alias("_sq"), "path", "x.now", "x.before", "x.f")
    both = both.groupBy("_st", "_sq", "path").agg(F.max("now").alias("now"), F.max("before").alias("before"), F.max("f").alias("_f"))
    pair = Window.partitionBy("_st", "_sq")
    mark = F.col("path").isNull()
    return (
        both.withColumns({"_there": F.max(F.when(mark, F.col("now").isNotNull() & F.col("before").isNotNull())).over(pair), "_f": F.max("_f").over(pair)})
        .where(F.col("_there") & ~mark).drop("_there")
    )


def _beside(rows: DataFrame, lists: DataFrame, size: Column, by: list[str], scratch: Scratch, how: str = "inner") -> DataFrame:
    """``rows`` with the list of their file (one row a file of ``lists``), by broadcast behind a count of what it holds.

    Beyond the bound the rows of large files stay where they are, and those of others move to their list.
    """
    lists = scratch.write(lists, "lists")
    if (lists.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_PATHS:
        return rows.join(F.broadcast(lists), by, how)
    sizes = scratch.write(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "sizes")
    hot = scratch.write(hot_keys(sizes, by, "n", sizes.agg(F.sum("n")).first()[0] or 0), "hot")
    return skew_join(rows, lists, by, hot if hot.head(1) else None, how)


def _values(rows: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(_st, _sq, _k, path, later, lo, hi): the values of the wanted paths in each notice of the two files of a pair."""
    sides = F.explode(F.array(
        F.struct(F.col("_sq"), F.col("_sq").alias("pair"), F.lit(True).alias("later"), F.col("new").alias("path")),
        F.struct((F.col("_sq") - 1).alias("_sq"), F.col("_sq").alias("pair"), F.lit(False).alias("later"), F.col("gone").alias("path")))).alias("x")
    need = wanted.select("_st", sides).select("_st", "x.*").groupBy("_st", "_sq").agg(F.collect_set(F.struct("pair", "later", "path")).alias("need"))
    again = _beside(rows.where("_k is not null and _p is not null").select("_st", "_sq", "_k", "_p"), need, F.size("need"), ["_st", "_sq"], scratch)
    root: list[PathNode] = []

    def kernel(cols):
        if not root:
            root.append(PathNode())
        names = ("_st", "_sq", "_k", "path", "later", "value")
        out: dict[str, list] = {n: [] for n in names}
        for st, k, text, need in zip(cols["_st"], cols["_k"], cols["_p"], cols["need"]):
            wanted: dict[str, list] = {}
            for n in need:
                wanted.setdefault(n["path"], []).append((n["pair"], n["later"]))
            # without escapes a key stands in the text as it is; a path's last key begins at a dot or at the start of it
            if "\\" not in text and not any(f'{last}"' in text for last in {p.rpartition(".")[2] for p in wanted}):
                continue
            got: dict[str, list[str]] = {}
            for node, v, _ in triples(text, root[0]) or ():
                if v is not None and node.text in wanted:
                    got.setdefault(node.text, []).append("oui" if v is True else "non" if v is False else str(v))
            for p, vs in got.items():
                for pair, later in wanted[p]:
                    for n, v in zip(names, (st, pair, k, p, later, "\x1f".join(vs))):
                        out[n].append(v)
        return out

    found = python_rows(again.select("_st", "_k", "_p", "need"), kernel, "_st long, _sq long, _k string, path string, later boolean, value string")
    return found.groupBy("_st", "_sq", "_k", "path", "later").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def _renames(rows: DataFrame, diff: DataFrame, scratch: Scratch) -> DataFrame:
    """(_st, _sq, gone, new): paths gone and new in the same object that hold the same value wherever both files tell."""
    by = ["_st", "_sq", "_o"]
    gone = diff.where("now is null").select("_st", "_sq", _parent(F.col("path")).alias("_o"), F.col("path").alias("gone"))
    new = diff.where("before is null").select("_st", "_sq", _parent(F.col("path")).alias("_o"), F.col("path").alias("new"))
    wanted = scratch.write(gone.join(new, by).drop("_o"), "wanted")
    values = scratch.write(_values(rows, wanted, scratch), "values")
    old = values.where("not later").select("_st", "_sq", "_k", F.col("path").alias("gone"), F.struct("lo", "hi").alias("was"))
    now = values.where("later").select("_st", "_sq", "_k", F.col("path").alias("new"), F.struct("lo", "hi").alias("is"))
    met = old.join(wanted, ["_st", "_sq", "gone"]).join(now, ["_st", "_sq", "_k", "new"])
    same = (F.col("was.lo") == F.col("was.hi")) & (F.col("was") == F.col("is"))
    return met.groupBy("_st", "_sq", "gone", "new").agg(F.bool_and(same).alias("same")).where("same").drop("same")


def changes(df: DataFrame, file: str = "raw_source_file", stream: str = "stream_no", seq: str = "file_seq", key: str = "idweb", payload: str = "donnees", scratch: Scratch | None = None) -> DataFrame:
    """(file, change_kind, field_path, new_field_path): every change of a file against the one before it in its stream."""
    scratch = scratch or Scratch(df.sparkSession, "drift")
    rows = _narrow(df, file, stream, seq, key, payload)
    schemas = scratch.write(file_schemas(rows), "schemas")
    diff = scratch.write(_differences(schemas).where("now is distinct from before"), "differences")
    renamed = scratch.write(_renames(rows, diff, scratch), "renames")
    moved = renamed.select("_st", "_sq", F.explode(F.array("gone", "new")).alias("path")).distinct()
    plain = diff.join(moved, ["_st", "_sq", "path"], "left_anti").select(
        "_f", F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("retyped").alias("change_kind"), F.col("path").alias("field_path"), F.lit("").alias("new_field_path"))
    named = renamed.join(diff.select("_st", "_sq", F.col("path").alias("gone"), "_f"), ["_st", "_sq", "gone"]).select("_f", F.lit("renamed").alias("change_kind"), F.col("gone").alias("field_path"), F.col("new").alias("new_field_path"))
    return plain.unionByName(named).withColumnRenamed("_f", file)


def union_schema(df: DataFrame, file: str = "raw_source_file", stream: str = "stream_no", seq: str = "file_seq", key: str = "idweb", payload: str = "donnees") -> DataFrame:
    """(field_path, union_type, types, n_files): the schemas of all files folded through the lattice."""
    per_file = file_schemas(_narrow(df, file, stream, seq, key, payload)).where("path is not null")
    folded = per_file.groupBy("path").agg(F.bit_or("types").alias("t"), F.count_distinct("_f").alias("n_files"))
    return folded.select(F.col("path").alias("field_path"), promoted(F.col("t")).alias("union_type"), type_names(F.col("t")).alias("types"), "n_files")


def newest_names(schemas: DataFrame, renamed: DataFrame) -> DataFrame:
    """(_st, _sq, path, name, types): each path of each file and what the last file of its stream calls it.

    A path follows the renames of later files one after the other; of several for one path in one file the first by name
    counts.  The rows are those of the schemas, and a file's paths and later renames meet in one row.
    """
    steps = renamed.groupBy("_st", F.col("_sq").alias("at"), "gone").agg(F.min("new").alias("new"))
    files = schemas.groupBy("_st", "_sq").agg(F.collect_set("path").alias("paths"))
    later = files.join(steps, "_st").where("at > _sq").groupBy("_st", "_sq").agg(F.first("paths").alias("paths"), F.sort_array(F.collect_list(F.struct("at", "gone", "new"))).alias("steps"))

    def kernel(cols):
        out: dict[str, list] = {"_st": [], "_sq": [], "path": [], "name": []}
        for st, sq, paths, steps in zip(cols["_st"], cols["_sq"], cols["paths"], cols["steps"]):
            of = {p: [p] for p in paths}  # what a path is called now -> the paths of the file that have come to be called so
            for step in steps:
                if step["gone"] in of:
                    of.setdefault(step["new"], []).extend(of.pop(step["gone"]))
            for name, ps in of.items():
                for p in ps:
                    if p != name:
                        out["_st"].append(st), out["_sq"].append(sq), out["path"].append(p), out["name"].append(name)
        return out

    moved = python_rows(later, kernel, "_st long, _sq long, path string, name string")
    by_file = schemas.where("path is not null").groupBy("_st", "_sq", "path").agg(F.bit_or("types").alias("types"))
    return by_file.join(moved, ["_st", "_sq", "path"], "left").select("_st", "_sq", "path", F.coalesce("name", "path").alias("name"), "types")


def unified(df: DataFrame, keep: list[str], file: str = "raw_source_file", stream: str = "stream_no", seq: str = "file_seq", key: str = "idweb", payload: str = "donnees", scratch: Scratch | None = None) -> DataFrame:
    """``keep`` and ``fields``, a struct with one typed column for each path of the union schema under its newest name.

    A renamed path has the name that the last file of its stream gives it; the types of all files and of both names fold
    into the column's.  A path that some record holds several times is an array, in document order.  In a column of mixed
    types booleans are the texts oui and non and numbers are as written; a double column rounds to doubles.  A record
    without a path, or that is not complete JSON, or of a null stream or file, has null there.  Of paths that differ in
    case only, which Spark takes for one, the later ones end in ~2 and so on.  The union schema, which a
    plan must know, goes to the driver; more than MOST_COLUMNS columns are refused.
    """
    from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructType

    scratch = scratch or Scratch(df.sparkSession, "unified")
    rows = _narrow(df, file, stream, seq, key, payload)
    schemas = scratch.write(file_schemas(rows), "schemas")
    diff = scratch.write(_differences(schemas).where("now is distinct from before"), "differences")
    renamed = scratch.write(_renames(rows, diff, scratch), "renames")
    names = scratch.write(newest_names(schemas, renamed), "names")
    # two paths of one file under one name may meet in one record
    meet = names.groupBy("_st", "_sq", "name").agg((F.bit_or("types").bitwiseOR(F.when(F.count(F.lit(1)) > 1, MANY).otherwise(0))).alias("types"))
    union = meet.groupBy("name").agg(F.bit_or("types").alias("t")).select("name", "t", promoted(F.col("t")).alias("type")).orderBy("name").limit(MOST_COLUMNS + 1).collect()
    if len(union) > MOST_COLUMNS:
        raise ValueError(f"the union schema has more than {MOST_COLUMNS} columns; see union_schema")
    moved = names.where("path <> name").groupBy("_st", "_sq").agg(F.map_from_entries(F.collect_list(F.struct("path", "name"))).alias("_moved"))
    wide = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{stream}`").cast("long").alias("_st"), F.col(f"`{seq}`").cast("long").alias("_sq"), F.when(F.col(f"`{stream}`").isNotNull() & F.col(f"`{seq}`").isNotNull(), F.col(f"`{payload}`").cast("string")).alias("_p"))
    met = _beside(wide, moved, F.size("_moved"), ["_st", "_sq"], scratch, "left")
    kinds = {"boolean": BooleanType(), "bigint": LongType(), "double": DoubleType(), "string": StringType()}
    parts, fields, taken = {}, StructType(), {}
    for u in union:
        kind, many = u["type"].removeprefix("array<").rstrip(">"), u["type"].startswith("array")
        taken[u["name"].lower()] = n = taken.get(u["name"].lower(), 0) + 1
        label = u["name"] if n == 1 else f"{u['name']}~{n}"
        parts[u["name"]] = (label, kind, many)
        fields.add(label, ArrayType(kinds[kind]) if many else kinds[kind])
    if not union:
        fields.add("_none", StringType())
    schema = StructType([df.schema[c] for c in keep]).add("fields", fields)
    root: list[PathNode] = []

    def cast(v, kind):
        if kind == "string":
            return "oui" if v is True else "non" if v is False else str(v)
        return v if kind == "boolean" else int(v) if kind == "bigint" else float(v)

    def kernel(cols):
        if not root:
            root.append(PathNode())
        out = []
        for text, moved in zip(cols["_p"], cols["_moved"]):
            to, got = dict(moved or ()), {}
            for node, v, _ in triples(text, root[0]) or ():
                if v is not None:
                    name = to.get(node.text, node.text)
                    label, kind, many = parts[name]
                    if many:
                        got.setdefault(label, []).append(cast(v, kind))
                    else:
                        got[label] = cast(v, kind)
            out.append(got)
        return {**{c: cols[c] for c in keep}, "fields": out}

    return python_rows(met, kernel, schema)
