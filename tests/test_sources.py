"""Every reader and writer on small files."""

import gzip
import json
import zipfile

from tessella.sources import spaces, writers


def key(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tab_and_unified(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("SMILES\tid\tset\trxn\nCC[U]\tf1\tR1\tx\n[U]N\tf2\t2\tx\nbad\t\t\tx\n")
    space, bad = spaces.read_tab(spark, str(tmp_path / "a.tsv"))
    assert key(space.synthons, "rxn_id", "set_idx", "frag_id", "connectors") == [("x", 1, "f1", 1), ("x", 2, "f2", 1)] and bad.count() == 1
    (tmp_path / "b.csv").write_text('reaction_id,Synton_ID,smiles,synton_role,PRICE\nr,"a ""q"" b",C[U],synton_1,2.5\nr,c,[U]O,2,\n')
    space, bad = spaces.read_unified(spark, str(tmp_path / "b.csv"))
    assert key(space.synthons, "frag_id", "set_idx") == [('a "q" b', 1), ("c", 2)] and bad.count() == 0
    assert [(r.frag_id, r.attributes) for r in space.attributes.collect()] == [('a "q" b', {"price": "2.5"})]


def test_folder_and_archive(spark, tmp_path):
    d = tmp_path / "f"
    d.mkdir()
    for name, text in (("amide_synthon_1.csv", "CC[U]"), ("amide_2_synthon.csv", "[U]N"), ("urea.csv", "O[U]")):
        (d / name).write_text(f"SMILES,bb1_parent_id,Price\n{text},id-{name},1\n")
    space, _ = spaces.read_reaction_files(spark, str(d))
    assert key(space.synthons, "rxn_id", "set_idx", "structure") == [("amide", 1, "CC[U]"), ("amide", 2, "[U]N"), ("urea", 1, "O[U]")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("s.csv", "SMILES,synton_id,reaction_id,synton_role\nCC[U],a,x,1\n[U]N,b,x,2\n")
        z.writestr("m.csv", "reaction_id,components,reaction,product,r1\nx,2,amide,-,acid\n")
    space, _ = spaces.read_archive(spark, str(tmp_path / "z.zip"), "s.csv", "m.csv")
    assert key(space.synthons, "frag_id", "connectors") == [("a", 1), ("b", 1)]
    assert space.reactions.first().metadata == {"supplier.reaction.components": "2", "supplier.reaction.reaction": "amide", "supplier.reaction.r1": "acid"}


def test_raw_round_trip(spark, tmp_path):
    raw = {"name": "n", "version": "1", "metadata": {"space.role": "downsampled"}, "reactions": [{
        "reactionId": "x", "fragmentSets": {"0": [{"reactionId": "x", "fragIndex": 0, "fragmentId": "a", "idcode": "CC[U]", "connectors": "AQ=="}], "1": [{"reactionId": "x", "fragIndex": 1, "fragmentId": "b", "idcode": "C", "connectors": None}]},
        "exampleScaffolds": ["CC"], "descriptors": {"d": "1"}, "reactionMetadata": {"k": "v"}, "fragmentAttributes": {"a": {"price": "3"}}}]}
    with gzip.open(tmp_path / "s.rawspace.json.gz", "wt") as f:
        json.dump(raw, f, indent=1)
    space = spaces.read_raw(spark, str(tmp_path / "s.rawspace.json.gz"))
    assert key(space.synthons, "rxn_id", "set_idx", "frag_id", "connectors") == [("x", 0, "a", 1), ("x", 1, "b", 0)]
    writers.write_raw(space, str(tmp_path / "out"), "n", single=True)
    again = writers.read_raw_lines(spark, str(tmp_path / "out")).collect()
    got = again[0].reactions[0]
    assert len(again) == 1 and got.fragmentSets["0"][0].connectors == "AQ==" and got.fragmentSets["1"][0].connectors is None
    assert got.reactionMetadata == {"k": "v"} and got.fragmentAttributes == {"a": {"price": "3"}} and got.exampleScaffolds == ["CC"]


def test_seeds_structures_tables(spark, tmp_path):
    seeds = spark.createDataFrame([("x", ["a", "b"], "C\tC", 3, 1, 0.5, 7)], "rxn_id string, frag_ids array<string>, assembled string, atoms int, rotatable_bonds int, similarity double, attempt long")
    writers.write_seeds(seeds, str(tmp_path / "seeds"))
    assert key(spaces.read_seeds(spark, str(tmp_path / "seeds")), "rxn_id", "frag_ids", "assembled", "similarity", "attempt") == [("x", ["a", "b"], "C C", 0.5, 7)]
    hits = spark.createDataFrame([("x", "CCO", ["a", "b"])], "rxn_id string, structure string, frag_ids array<string>")
    assert writers.wide_hits(hits).first().asDict() == {"rxn_id": "x", "structure": "CCO", "frag1": "a", "frag2": "b", "frag3": "", "frag4": ""}
    writers.write_dwar(hits.select("structure", "rxn_id").coalesce(1), str(tmp_path / "d"))
    assert key(spaces.read_dwar(spark, str(tmp_path / "d")), "structure", "rxn_id") == [("CCO", "x")]
    (tmp_path / "q.smi").write_text("# c\nCCO ethanol x\n\nC\n")
    assert sorted((r.structure, r.name) for r in spaces.read_structures(spark, str(tmp_path / "q.smi")).collect()) == [("C", None), ("CCO", "ethanol x")]
    (tmp_path / "m.sdf").write_text("one\n  x\n\n  0  0\nM  END\n>  <K>\nv1\n\n$$$$\ntwo\n\n\nM  END\n$$$$\n")
    assert sorted((r.name, r.fields) for r in spaces.read_sdf(spark, str(tmp_path / "m.sdf")).collect()) == [("one", {"K": "v1"}), ("two", {})]


def test_inputs(tmp_path):
    for n in ("a.rawspace.gz", "b.rawspace.gz"):
        (tmp_path / n).write_text("")
    (tmp_path / "list.txt").write_text("# all\nb.rawspace.gz # again\nc.rawspace.gz\n")
    got = spaces.resolve_inputs([f"{tmp_path},{tmp_path}/list.txt"])
    assert [g.rpartition("/")[2] for g in got] == ["a.rawspace.gz", "b.rawspace.gz", "c.rawspace.gz"]
