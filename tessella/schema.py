"""Schemas of combinatorial spaces as columnar tables, in DDL form."""

from __future__ import annotations

SYNTHONS = "rxn_id string, set_idx int, frag_id string, structure string, connectors int"
ATTRIBUTES = "rxn_id string, frag_id string, attributes map<string,string>"
REACTIONS = (
    "rxn_id string, example_scaffolds array<string>, partial_assemblies map<string,array<string>>, "
    "representative_compounds array<string>, descriptors map<string,string>, metadata map<string,string>"
)
SPACES = "name string, version string, metadata map<string,string>"
HITS = "hit_id string, rxn_id string, set_idx int, frag_ids array<string>"
SEEDS = "rxn_id string, frag_ids array<string>, assembled string, atoms int, rotatable_bonds int, similarity double, attempt long"
#: The nested JSON form of a raw space.
RAW_FRAGMENT = "struct<reactionId:string,fragIndex:int,fragmentId:string,idcode:string,connectors:string>"
RAW_REACTION = (
    f"struct<reactionId:string,fragmentSets:map<string,array<{RAW_FRAGMENT}>>,"
    "exampleScaffolds:array<string>,partialAssemblies:map<string,array<string>>,representativeCompounds:array<string>,"
    "descriptors:map<string,string>,reactionMetadata:map<string,string>,fragmentAttributes:map<string,map<string,string>>>"
)
RAW_SPACE = f"name string, version string, metadata map<string,string>, reactions array<{RAW_REACTION}>"
MAX_CONNECTORS = 8
CONNECTOR_ATOMS = ("U", "Np", "Pu", "Am", "Cm", "Bk", "Cf", "Es")
