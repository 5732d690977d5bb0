"""JSON in: batch folders and continuous folders of schema-free objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import values as V
from docweave.operators.pairs import with_normal_map
from docweave.session import stage

# One attribute of an object, before its map is built.  ``kind`` is the first letters of
# the value's type name (OBJECT, ARRAY, ...), NULL where it could not be told.
ENTRY = "struct<key:string,value:string,kind:string>"


STRICT = {"mode": "FAILFAST"}


def _entries(text: Column, objects: str) -> tuple[Column, Column]:
    """Parse JSON text twice: values as text, and values as variants for their kinds.

    Text keeps ``1`` and ``1.0`` apart, which a variant does not; a variant tells the
    object ``{"x":1}`` from a string with the same characters, which text does not.
    Malformed text fails the job rather than losing documents.  Variants refuse repeated
    keys in nested objects; kinds are then missing and guessed from the text.
    """
    shape = "array<map<string,{}>>" if objects == "array" else "map<string,{}>"
    return F.from_json(text, shape.format("string"), STRICT), F.from_json(text, shape.format("variant"))


def _with_kinds(texts: Column, variants: Column) -> Column:
    """Zip the two parses of one object into ``ARRAY<ENTRY>``."""
    kinds = F.transform(F.map_entries(variants), lambda e: F.schema_of_variant(e["value"]))
    kinds = F.coalesce(kinds, F.array().cast("array<string>"))
    both = F.arrays_zip(F.map_entries(texts).alias("t"), kinds.alias("k"))
    return F.transform(
        both,
        lambda z: F.struct(
            z["t"]["key"].alias("key"), z["t"]["value"].alias("value"), z["k"].alias("kind")
        ),
    )


def _is_object(e: Column) -> Column:
    known = e["kind"].startswith("OBJECT")
    return F.coalesce(known, e["value"].startswith("{"), F.lit(False))


def _canonical_object(text: Column) -> Column:
    """JSON text of an object with its keys in order."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def object_depth(text: Column) -> Column:
    """How deep braces nest in JSON text, those in strings left out."""
    braces = F.regexp_replace(F.regexp_replace(text, r'"(\\.|[^"\\])*"', ""), r"[^{}]", "")
    steps = F.transform(F.split(braces, ""), lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
    most = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")),
        lambda s, d: F.struct((s["at"] + d).alias("at"), F.greatest(s["most"], s["at"] + d).alias("most")),
        lambda s: s["most"],
    )
    return F.coalesce(most, F.lit(0))


def nested_policy(entries: Column, nested: str = "drop", depth: int | None = None) -> Column:
    """What becomes of object-valued attributes in ``ARRAY<ENTRY>``.

    ``drop`` removes them, ``whole`` keeps their canonical JSON text as the value, and
    ``flatten`` replaces them by their members under ``parent_child`` names, ``depth`` levels
    down; an object below that fails the job.
    """
    if nested == "drop":
        return F.filter(entries, lambda e: ~_is_object(e))
    if nested == "flatten":
        if depth is None:
            raise ValueError("flatten needs the depth of the objects")
        for _ in range(depth):
            entries = F.flatten(F.transform(entries, _children_or_self))
        deeper = F.raise_error(F.lit(f"objects nest deeper than {depth} levels")).cast(ENTRY)
        # Entry by entry: a look at the whole array before would parse every level twice.
        return F.transform(entries, lambda e: F.when(_is_object(e), deeper).otherwise(e))
    elif nested != "whole":
        raise ValueError("nested must be 'drop', 'whole' or 'flatten'")
    return F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("key"),
            F.when(_is_object(e), _canonical_object(e["value"])).otherwise(e["value"]).alias("value"),
            e["kind"].alias("kind"),
        ),
    )


def _children_or_self(e: Column) -> Column:
    children = F.transform(
        _with_kinds(*_entries(e["value"], "one")),
        lambda c: F.struct(
            F.concat_ws("_", e["key"], c["key"]).alias("key"), c["value"].alias("value"), c["kind"].alias("kind")
        ),
    )
    return F.when(_is_object(e), F.coalesce(children, F.array().cast(f"array<{ENTRY}>"))).otherwise(F.array(e))


def with_document_map(
    df: DataFrame, nested: str = "drop", nulls: str = "text", set_attrs: tuple[str, ...] = (), depth: int | None = None
) -> DataFrame:
    """Column ``e ARRAY<ENTRY>`` to the document map ``m``: nesting, set-valued attributes,
    text, last key."""
    kept = nested_policy(F.col("e"), nested, depth)
    if set_attrs:
        kept = F.transform(
            kept,
            lambda e: F.struct(
                e["key"].alias("key"),
                F.when(e["key"].isin(list(set_attrs)), V.canonical_set_text(e["value"]))
                .otherwise(e["value"])
                .alias("value"),
            ),
        )
    return with_normal_map(df, kept, nulls).drop("e")


def parse_documents(texts: DataFrame, layout: str = "array", id_attr: str | None = None, **rules) -> DataFrame:
    """Rows ``(file, value)`` of JSON text to ``(doc, file, m)``, one row per object.

    The id is ``file#position`` for arrays; ``id_attr`` takes it from an attribute instead.
    ``rules`` go to ``with_document_map``.
    """
    if layout == "array":
        text, variant = _entries(F.col("value"), "array")
        variant = F.coalesce(variant, F.array().cast("array<map<string,variant>>"))
        parsed = F.posexplode(F.arrays_zip(text.alias("t"), variant.alias("v")))
        objects = texts.select("file", parsed.alias("pos", "_o")).select(
            F.concat_ws("#", "file", "pos").alias("doc"),
            "file",
            _with_kinds(F.col("_o.t"), F.col("_o.v")).alias("e"),
        )
    else:
        # One object per line, with or without the brackets and commas of an array.
        body = F.regexp_replace(F.regexp_replace("value", r"^\s*[\[,]?\s*", ""), r"\s*[,\]]?\s*$", "")
        lines = texts.withColumn("value", body).where("value != ''")
        text, variant = _entries(F.col("value"), "one")
        doc = F.col("doc") if "doc" in texts.columns else F.lit(None).cast("string")
        objects = lines.select(doc.alias("doc"), "file", _with_kinds(text, variant).alias("e"))
    documents = with_document_map(objects, **rules)
    if id_attr:
        documents = documents.withColumn("doc", F.try_element_at("m", F.lit(id_attr))).withColumn(
            "m", F.map_filter("m", lambda k, _: k != id_attr)
        )
    return documents


def _texts(reader, path: str, layout: str) -> DataFrame:
    return reader.text(path, wholetext=layout == "array").select(
        F.col("_metadata.file_path").alias("file"), "value"
    )


def read_json_documents(
    spark: SparkSession, path: str, layout: str = "array", id_attr: str | None = None, **rules
) -> DataFrame:
    """Folder of JSON files to documents ``(doc, file, m)``.

    ``layout='array'``: each file is one JSON array of objects and is parsed as a unit, so
    keep files moderate (tens of MB); parallelism comes from many files.
    ``layout='lines'``: one object per line; Spark splits files of any size.  Without
    ``id_attr`` the lines are numbered as they are read and staged once, so that the ids
    stay the same in every later use.
    """
    texts = _texts(spark.read, path, layout)
    if layout == "lines" and id_attr is None:
        number = F.monotonically_increasing_id()
        texts = stage(texts.withColumn("doc", F.concat_ws("#", "file", number)))
    if rules.get("nested") == "flatten" and rules.get("depth") is None:
        # Braces of the document itself are no level; arrays of objects only make this too large.
        most = texts.agg(F.max(object_depth(F.col("value")))).first()[0] or 0
        rules = rules | {"depth": max(0, most - 1)}
    return parse_documents(texts, layout, id_attr, **rules)


def stream_documents(
    spark: SparkSession, path: str, max_files: int = 1, layout: str = "array", id_attr: str | None = None, **rules
) -> DataFrame:
    """Continuous folder source of the same documents; lines need an ``id_attr``, and
    ``nested='flatten'`` the ``depth`` of the objects."""
    if layout == "lines" and id_attr is None:
        raise ValueError("a stream of lines needs id_attr: lines have no stable number")
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    return parse_documents(_texts(reader, path, layout), layout, id_attr, **rules)


def stream_table(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Continuous folder of parquet files, to be turned into documents by
    ``documents_from_table``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
