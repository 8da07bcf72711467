"""Writers of spaces, hits and reports. All are Spark writers: a folder of part files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import bits
from tessella.sources.spaces import Space


def clean(column: Column) -> Column:
    """Text for a tab-separated line: tabs and line ends become spaces."""
    return F.translate(column.cast("string"), "\t\r\n", "   ")


def _tab(rows: DataFrame, path: str, **options) -> None:
    rows.write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", **options).csv(path)


def raw_documents(space: Space, name: str, version: str = "1", metadata: dict[str, str] | None = None) -> DataFrame:
    """K1: the space as one nested row for each reaction; no connectors are null, others Base64."""
    words = F.array(F.col("connectors").cast("long"))
    stored = F.when(F.col("connectors") != 0, bits.to_base64(words))
    member = F.struct(F.col("rxn_id").alias("reactionId"), F.col("set_idx").alias("fragIndex"), F.col("frag_id").alias("fragmentId"), F.col("structure").alias("idcode"), stored.alias("connectors"))
    sets = space.synthons.groupBy("rxn_id", "set_idx").agg(F.sort_array(F.collect_list(member)).alias("members"))
    out = sets.groupBy("rxn_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("set_idx").cast("string"), "members")))).alias("fragmentSets"))
    if space.reactions is not None:
        out = out.join(space.reactions.drop("space"), "rxn_id", "left")
    if space.attributes is not None:
        own = space.attributes.groupBy("rxn_id").agg(F.map_from_entries(F.collect_list(F.struct("frag_id", "attributes"))).alias("fragmentAttributes"))
        out = out.join(own, "rxn_id", "left")
    have = set(out.columns)
    renamed = {
        "example_scaffolds": ("exampleScaffolds", "array<string>"), "partial_assemblies": ("partialAssemblies", "map<string,array<string>>"),
        "representative_compounds": ("representativeCompounds", "array<string>"), "descriptors": ("descriptors", "map<string,string>"),
        "metadata": ("reactionMetadata", "map<string,string>"), "fragmentAttributes": ("fragmentAttributes", "map<string,map<string,string>>"),
    }
    fields = [F.col(c).alias(to) if c in have else F.lit(None).cast(kind).alias(to) for c, (to, kind) in renamed.items()]
    reaction = F.struct(F.col("rxn_id").alias("reactionId"), "fragmentSets", *fields)
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), F.lit(v))]
    meta = F.create_map(*pairs).cast("map<string,string>") if pairs else F.create_map().cast("map<string,string>")
    return out.select(F.lit(name).alias("name"), F.lit(version).alias("version"), meta.alias("metadata"), F.array(reaction).alias("reactions"))


def write_raw(space: Space, path: str, name: str, version: str = "1", metadata: dict[str, str] | None = None, gz: bool = True, single: bool = False) -> None:
    """K1: nested JSON. A document holds one reaction, so that large spaces split; with
    ``single`` the whole space, which must fit in one task, is one document."""
    docs = raw_documents(space, name, version, metadata)
    if single:
        one = F.flatten(F.collect_list("reactions"))
        docs = docs.groupBy("name", "version").agg(F.first("metadata").alias("metadata"), one.alias("reactions"))
    docs.write.mode("overwrite").option("compression", "gzip" if gz else "none").option("lineSep", "\n").json(path)


def read_raw_lines(spark, *paths: str) -> DataFrame:
    """What :func:`write_raw` wrote, one document a line."""
    from tessella import schema

    return spark.read.schema(schema.RAW_SPACE).json(list(paths))


def write_seeds(seeds: DataFrame, path: str, hits_per_file: int = 100_000) -> None:
    """K2: seeds as tab-separated text; a file ends after ``hits_per_file`` rows."""
    rows = seeds.select(
        clean(F.col("rxn_id")).alias("rxnId"), clean(F.array_join("frag_ids", ";")).alias("fragIds"), clean(F.col("assembled")).alias("assembledIdcode"), "atoms",
        F.col("rotatable_bonds").alias("rotatableBonds"), F.col("similarity").alias("phesaSimilarity"), F.col("attempt").alias("attemptIndex"),
    )
    _tab(rows, path, maxRecordsPerFile=hits_per_file)


def write_optimised(hits: DataFrame, path: str, source: str | None = None) -> None:
    """K3: optimised hits ``rxn_id, frag_ids, assembled, atoms, rotatable_bonds, similarity,
    position, seed_frag_ids``; with ``source``, that column becomes ``sourceSpace``."""
    more = [clean(F.col(source)).alias("sourceSpace")] if source else []
    rows = hits.select(
        clean(F.col("rxn_id")).alias("rxnId"), *more, clean(F.array_join("frag_ids", ";")).alias("fragIds"), clean(F.col("assembled")).alias("Structure [idcode]"), "atoms",
        F.col("rotatable_bonds").alias("rotatableBonds"), F.col("similarity").alias("phesaSimilarity"), F.col("position").alias("attemptIndex"),
        clean(F.array_join("seed_frag_ids", ";")).alias("seedFragIds"),
    )
    _tab(rows, path)


def wide_hits(hits: DataFrame, columns: int = 4) -> DataFrame:
    """K4: enumerated hits with one column for each fragment, padded to ``columns``."""
    return hits.select("rxn_id", "structure", *[F.coalesce(F.try_element_at("frag_ids", F.lit(i + 1)), F.lit("")).alias(f"frag{i + 1}") for i in range(columns)])


def write_hits(hits: DataFrame, path: str, sep: str = ",") -> None:
    wide_hits(hits).write.mode("overwrite").options(sep=sep, header=True, escape='"').csv(path)


def write_dwar(rows: DataFrame, path: str, structure: str = "structure") -> None:
    """K5: a DataWarrior table. Tags frame the rows of every part file, so each opens alone."""
    names = rows.columns
    properties = f'<datawarrior-fileinfo>\n<version="3.3">\n</datawarrior-fileinfo>\n<column properties>\n<columnName="{structure}">\n<columnProperty="specialType\tidcode">\n</column properties>\n'
    head = properties + "\t".join(names)

    def lines(frames):
        import pandas as pd

        yield pd.DataFrame({"value": [head]})
        for frame in frames:
            yield pd.DataFrame({"value": frame["value"]})
        yield pd.DataFrame({"value": ["<datawarrior properties>\n</datawarrior properties>"]})

    text = rows.select(F.concat_ws("\t", *[F.coalesce(clean(F.col(f"`{c}`")), F.lit("")) for c in names]).alias("value"))
    text.mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def write_similarity(hits: DataFrame, path: str) -> None:
    """K6: similarity hits ``structure, sim_a, sim_b, rxn_id, sim_total``."""
    rows = hits.select(F.col("structure").alias("Hit"), F.col("sim_a").alias("SimSkelSpheres"), F.col("sim_b").alias("SimFragFp"), F.col("rxn_id").alias("Rxn"), F.col("sim_total").alias("SimA2"))
    rows.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_synthon_list(stats: DataFrame, path: str) -> None:
    """K7: unique synthons ``structure, atoms, n_spaces, n_sets``."""
    rows = stats.select(clean(F.col("structure")).alias("Structure[idcode]"), F.col("atoms").alias("NumAtoms"), F.col("n_spaces").alias("NumSpaces"), F.col("n_sets").alias("NumSynthonSets"))
    _tab(rows, path)


def write_report(rows: DataFrame, path: str) -> None:
    """K8: a report of measurements as CSV, one file."""
    rows.coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(path)  # a report is small


def publish(stream: DataFrame, send: Callable[[list[str]], None], checkpoint: str, batch_rows: int = 1000):
    """K9: hand the rows of a stream, as JSON texts, to ``send`` in lists of ``batch_rows``.

    Each executor sends its own rows; ``send`` must be safe to repeat after a retry.
    """

    def one(frame: DataFrame, number: int) -> None:
        def deliver(rows):
            held: list[str] = []
            for r in rows:
                held.append(r[0])
                if len(held) == batch_rows:
                    send(held)
                    held = []
            if held:
                send(held)

        frame.select(F.to_json(F.struct(*frame.columns))).foreachPartition(deliver)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
