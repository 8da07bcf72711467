"""Readers of combinatorial spaces.

Every reader returns tables of ``tessella.schema``: ``synthons(rxn_id, set_idx, frag_id,
structure, connectors)`` and, where a format has them, reactions, attributes and spaces.
Rows that do not parse are never lost silently: readers of loose text return them as a
second table.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions import bits, scalars


@dataclass
class Space:
    """A space as four tables; those a format lacks are None."""

    synthons: DataFrame
    attributes: DataFrame | None = None
    reactions: DataFrame | None = None
    spaces: DataFrame | None = None


def mask_from_base64(column: Column) -> Column:
    """Connectors of a stored bitset; null, like an empty one, has none."""
    return F.coalesce(bits.from_base64(column, 1)[0], F.lit(0)).cast("int")


def read_raw(spark: SparkSession, *paths: str) -> Space:
    """Nested JSON spaces, ``.gz`` or not, one document a file.

    Connectors come from the stored bitset, or from the structure where there is none.
    """
    raw = spark.read.schema(schema.RAW_SPACE).option("multiLine", True).json(list(paths))
    spaces = raw.select("name", "version", "metadata")
    flat = raw.select(F.col("name").alias("space"), F.inline("reactions"))
    sets = flat.select("space", F.col("reactionId").alias("rxn_id"), F.explode("fragmentSets").alias("set_key", "members"))
    rows = sets.select("space", "rxn_id", F.col("set_key").cast("int").alias("set_idx"), F.explode("members").alias("m"))
    stored = F.when(F.col("m.connectors").isNotNull(), mask_from_base64(F.col("m.connectors"))).otherwise(bits.connector_mask(F.col("m.idcode")))
    synthons = rows.select("space", "rxn_id", "set_idx", F.col("m.fragmentId").alias("frag_id"), F.col("m.idcode").alias("structure"), stored.alias("connectors"))
    reactions = flat.select(
        "space", F.col("reactionId").alias("rxn_id"), F.col("exampleScaffolds").alias("example_scaffolds"), F.col("partialAssemblies").alias("partial_assemblies"),
        F.col("representativeCompounds").alias("representative_compounds"), "descriptors", F.col("reactionMetadata").alias("metadata"),
    )
    attributes = flat.select("space", F.col("reactionId").alias("rxn_id"), F.explode("fragmentAttributes").alias("frag_id", "attributes"))
    return Space(synthons, attributes, reactions, spaces)


def _synthons(rows: DataFrame, rxn: Column, index: Column, frag: Column, structure: Column, *more: Column) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and the rows that lack a reaction, a set, an id or a structure."""
    named = rows.select(F.trim(rxn).alias("rxn_id"), scalars.lenient_index(index).alias("set_idx"), F.trim(frag).alias("frag_id"), F.trim(structure).alias("structure"), *more)
    whole = F.col("set_idx").isNotNull()
    for c in ("rxn_id", "frag_id", "structure"):
        whole = whole & F.col(c).isNotNull() & (F.col(c) != "")
    good = named.where(whole).withColumn("connectors", bits.connector_mask(F.col("structure")))
    return good, named.where(~F.coalesce(whole, F.lit(False)))


def read_tab(spark: SparkSession, *paths: str) -> tuple[Space, DataFrame]:
    """``structure, id, set, reaction`` by place, tab-separated, the first line a header."""
    rows = spark.read.schema("s string, f string, i string, r string").csv(list(paths), sep="\t", header=True, enforceSchema=True, quote="")
    good, bad = _synthons(rows, F.col("r"), F.col("i"), F.col("f"), F.col("s"))
    return Space(good), bad


def _separator(spark: SparkSession, path: str) -> str:
    head = spark.read.text(path).first()
    return "\t" if head and "\t" in head[0] else ","


def read_unified(
    spark: SparkSession, path: str, structure: str = "SMILES", frag: str = "synton_id", rxn: str = "reaction_id", index: str = "synton_role", price: str | None = "price"
) -> tuple[Space, DataFrame]:
    """One file with named columns in any order and case; quotes double inside quotes.

    The separator is a tab if the header has one. A price becomes an attribute.
    """
    rows = spark.read.csv(path, sep=_separator(spark, path), header=True, quote='"', escape='"', mode="PERMISSIVE")
    columns = {c.strip().lower(): c for c in rows.columns}

    def find(name: str) -> Column:
        if name.lower() not in columns:
            raise ValueError(f"{path} has no column {name!r}")
        return F.col(f"`{columns[name.lower()]}`")

    more = [find(price).try_cast("double").alias("price")] if price and price.lower() in columns else []
    good, bad = _synthons(rows, find(rxn), find(index), find(frag), find(structure), *more)
    attributes = None
    if more:
        priced = good.where("price is not null")
        attributes = priced.select("rxn_id", "frag_id", F.create_map(F.lit("price"), F.col("price").cast("string")).alias("attributes"))
        good = good.drop("price")
    return Space(good, attributes), bad


def read_reaction_files(spark: SparkSession, folder: str, structure: str = "SMILES", frag: str = "bb1_parent_id", price: str = "Price") -> tuple[Space, DataFrame]:
    """A CSV file for each set; its name has the reaction and the set's number.

    ``amide_synthon_2.csv`` and ``amide_2_synthon.csv`` are set 2 of ``amide``; files without
    a number are numbered by name within their reaction. Equal reactions merge.
    """
    rows = spark.read.csv(folder.rstrip("/") + "/*.csv", header=True, quote='"', escape='"').withColumn("file_", F.input_file_name())
    columns = {c.strip().lower(): c for c in rows.columns}
    stem = F.regexp_replace(F.regexp_replace(F.col("file_"), r"^.*/", ""), r"\.[^.]*$", "")
    plain = F.regexp_replace(stem, r"_synthons?(?=_[0-9]+$|$)", "")
    rxn = F.regexp_replace(plain, "_[0-9]+$", "")
    given = F.regexp_extract(plain, "_([0-9]+)$", 1)
    files = rows.select("file_").distinct().select("file_", rxn.alias("rxn_"), given.alias("given_"))
    from pyspark.sql.window import Window

    by_name = F.row_number().over(Window.partitionBy("rxn_").orderBy("file_"))  # a row for each file
    files = files.withColumn("set_", F.when(F.col("given_") != "", F.col("given_")).otherwise(by_name.cast("string")))
    named = rows.join(files, "file_")
    good, bad = _synthons(named, F.col("rxn_"), F.col("set_"), F.col(f"`{columns[frag.lower()]}`"), F.col(f"`{columns[structure.lower()]}`"), *([F.col(f"`{columns[price.lower()]}`").try_cast("double").alias("price")] if price.lower() in columns else []))
    attributes = None
    if "price" in good.columns:
        attributes = good.where("price is not null").select("rxn_id", "frag_id", F.create_map(F.lit("price"), F.col("price").cast("string")).alias("attributes"))
        good = good.drop("price")
    return Space(good, attributes), bad


ROLES = ("r1", "r2", "r3", "r4")


def read_archive(spark: SparkSession, path: str, entry: str, metadata_entry: str | None = None) -> tuple[Space, DataFrame]:
    """A unified table inside a ZIP archive, with a table of reaction metadata beside it.

    Columns ``components, reaction, product, r1..r4`` become ``supplier.reaction.*``; a dash
    is no value. Each archive is opened where Spark reads it.
    """

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for kind, name in (("rows", entry), ("metadata", metadata_entry)):
                        if name in z.namelist():
                            with z.open(name) as f:
                                for chunk in pd.read_csv(f, sep=None, engine="python", dtype=str, keep_default_na=False, chunksize=20_000):
                                    records = [{k.strip().lower(): v for k, v in r.items()} for r in chunk.to_dict("records")]
                                    yield pd.DataFrame({"kind": kind, "fields": records})

    files = spark.read.format("binaryFile").load(path).select("content")
    table = files.mapInPandas(lines, "kind string, fields map<string,string>")
    get = lambda k: F.try_element_at("fields", F.lit(k))
    good, bad = _synthons(table.where("kind = 'rows'"), get("reaction_id"), get("synton_role"), get("synton_id"), get("smiles"))
    names = ("components", "reaction", "product", *ROLES)
    pairs = F.map_from_arrays(F.array(*[F.lit(f"supplier.reaction.{n}") for n in names]), F.array(*[get(n) for n in names]))
    meta = F.map_filter(pairs, lambda k, v: v.isNotNull() & ~v.isin("", "-"))
    reactions = table.where("kind = 'metadata'").select(get("reaction_id").alias("rxn_id"), meta.alias("metadata"))
    return Space(good, None, reactions), bad


def read_building_blocks(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A side table: ``id`` and a map of all other columns that have a value."""
    rows = spark.read.csv(path, sep=_separator(spark, path), header=True, quote='"', escape='"')
    others = [c for c in rows.columns if c != key]
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in others]), F.array(*[F.col(f"`{c}`") for c in others]))
    return rows.select(F.col(f"`{key}`").alias("id"), F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("values"))


def read_seeds(spark: SparkSession, *paths: str) -> DataFrame:
    """Seeds of a search; only the reaction and the fragments must be there."""
    rows = spark.read.csv(list(paths), sep="\t", header=True)
    columns = {c.strip().lower(): c for c in rows.columns}
    if "rxnid" not in columns or "fragids" not in columns:
        raise ValueError("seeds need the columns rxnId and fragIds")

    def find(name: str, kind: str) -> Column:
        c = columns.get(name)
        return (F.col(f"`{c}`") if c else F.lit(None).cast("string")).try_cast(kind)

    score = F.coalesce(find("phesasimilarity", "double"), F.lit(float("nan")))
    structure = find("assembledidcode", "string")
    return rows.select(
        find("rxnid", "string").alias("rxn_id"), F.filter(F.split(F.trim(find("fragids", "string")), r";\s*"), lambda x: x != "").alias("frag_ids"), structure.alias("assembled"),
        find("atoms", "int").alias("atoms"), find("rotatablebonds", "int").alias("rotatable_bonds"), score.alias("similarity"), find("attemptindex", "long").alias("attempt"),
    ).where("rxn_id is not null and size(frag_ids) > 0")


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Query structures, one a line: ``structure, name``; blank lines and ``#`` lines go."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')")
    parts = F.split(F.trim("value"), r"\s+", 2)
    return lines.select(parts[0].alias("structure"), F.try_element_at(parts, F.lit(2)).alias("name"))


def read_dwar(spark: SparkSession, path: str) -> DataFrame:
    """The table of a DataWarrior file, all columns as text.

    Everything before the header row is between tags, and so is what follows the rows.
    """
    lines = spark.read.text(path)
    known = lines.where("not startswith(value, '<') and contains(value, '\t')").first()
    if known is None:
        raise ValueError(f"{path} has no table")
    names = known[0].split("\t")
    rows = lines.where("not startswith(value, '<') and contains(value, '\t')").where(F.col("value") != known[0])
    parts = F.split("value", "\t", -1)
    return rows.where(F.size(parts) == len(names)).select(*[parts[i].alias(n) for i, n in enumerate(names)])


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """Records of a structure file: ``name, block, fields``; records end with ``$$$$``."""
    rows = spark.read.option("lineSep", "$$$$").text(path)
    text = F.regexp_replace("value", r"^\r?\n", "")
    fields = F.regexp_extract_all(text, F.lit(r"(?m)^>\s*<([^>]+)>.*\n((?:.*\S.*\n?)*)"), F.lit(0))
    entry = lambda x: F.struct(F.regexp_extract(x, r"<([^>]+)>", 1).alias("key"), F.trim(F.regexp_replace(x, r"^>.*\n", "")).alias("value"))
    pairs = F.transform(fields, lambda x: F.struct(entry(x)["key"], F.regexp_replace(entry(x)["value"], r"\s+$", "")))
    block = F.regexp_extract(text, r"(?s)^(.*?M  END)", 1)
    return rows.where(F.trim(F.regexp_replace("value", r"\s", "")) != "").select(F.trim(F.regexp_extract(text, r"^([^\n]*)", 1)).alias("name"), block.alias("block"), F.map_from_entries(pairs).alias("fields"))


def resolve_inputs(inputs: list[str], suffix: str = ".rawspace.gz") -> list[str]:
    """Files named one by one, in comma lists, by folder or by manifest, each once, in order.

    A manifest (``.txt``) has one path a line, relative to itself; ``#`` starts a comment.
    """
    found: dict[str, None] = {}

    def add(item: str, base: str = "") -> None:
        item = item.strip()
        if not item:
            return
        path = item if os.path.isabs(item) or re.match(r"\w+://", item) else os.path.join(base, item)
        if os.path.isdir(path):
            for name in sorted(os.listdir(path)):
                if name.endswith(suffix):
                    found.setdefault(os.path.join(path, name))
        elif path.endswith(".txt"):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    add(line.split("#")[0], os.path.dirname(path))
        else:
            found.setdefault(path)

    for given in inputs:
        for item in given.split(","):
            add(item)
    return list(found)


def read_manifest(spark: SparkSession, path: str) -> list[tuple[str, Space]]:
    """Spaces of a manifest ``name, input, tag``; a tag becomes the column ``tag``.

    The manifest is a list of files, which the driver walks; each is read in parallel.
    """
    out = []
    for row in spark.read.csv(path, sep="\t", header=True).collect():
        name, source, tag = (list(row) + [None])[:3]
        base = os.path.join(os.path.dirname(path), source) if not os.path.isabs(source) and "://" not in source else source
        space = read_raw(spark, base) if ".rawspace" in base else read_unified(spark, base)[0] if base.endswith(".csv") else read_tab(spark, base)[0]
        space.synthons = space.synthons.drop("space").withColumn("space", F.lit(name)).withColumn("tag", F.lit(tag))
        out.append((name, space))
    return out


def union_spaces(spaces: list[tuple[str, Space]]) -> DataFrame:
    """The synthons of several spaces with their source, ready for ``ranking.merge_spaces``."""
    out = None
    for name, space in spaces:
        rows = space.synthons.drop("space", "tag").withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no spaces")
    return out
