"""Domain-shaped views over the base tables.

Each view is one SQL text in the dialect shared by Spark and DuckDB, so a query and the SQL it is
checked against start from the same rows.  Every view grows with its base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

VIEWS: dict[str, str] = {
    # one row per (prey, bait, replicate); gaps are deterministic
    "intensity": """
        select concat('P', pk) as prey, concat('B', sk) as bait, r as replicate,
               case when (pk + 3 * sk + r) % 13 = 0 then null else v end as value
        from (select l_partkey as pk, l_suppkey % 12 as sk, l_linenumber % 3 as r,
                     max(l_extendedprice) as v
              from {lineitem} group by 1, 2, 3) cell""",
    # full replicate sets only, log2 scale
    "complete": """
        select prey, bait, replicate, log2(value) as value from {intensity}
        where value is not null""",
    "scores": """
        select concat('G', l_suppkey) as target, concat('G', l_partkey) as prey,
               concat('P00', l_linenumber % 3 + 1) as plate, l_quantity / 2.5 as pvals,
               round((l_discount - 0.04) * 100, 2) as enrichment,
               round(l_tax * 5, 2) as interaction_stoi, l_extendedprice / 10000 as abundance_stoi,
               l_orderkey * 8 + l_linenumber as row_key
        from {lineitem}""",
    "edges": """
        select target, prey, max(pvals) as weight from {scores}
        where enrichment > 0 and pvals > 16 group by target, prey""",
    # reference pairs and gene sets
    "corum": """
        select distinct concat('G', l_suppkey) as prot_1, concat('G', l_partkey) as prot_2
        from {lineitem} where l_returnflag = 'R' and l_suppkey <> l_partkey""",
    "clusters": """
        select concat('C', p_size) as cluster_id, concat('S', p_size, '_', p_partkey % 2) as subcluster_id,
               case when p_partkey % 3 = 0 then concat('K', p_size) end as core_id,
               concat('G', p_partkey) as gene from {part}""",
    "localization": """
        select concat('G', p_partkey) as gene,
               case p_size % 7 when 0 then 'N' when 1 then 'C' when 2 then 'O' when 3 then 'N/C'
                    when 4 then 'O/C' when 5 then 'B' else 'I' end as label from {part}
        where p_partkey % 11 <> 0""",
    # baits named by gene symbol, and the complexes they belong to
    "bait_gene": """
        select distinct concat('B', sk) as bait,
               case when sk % 4 = 0 then concat('MED', sk) when sk % 4 = 1 then concat('POLR', sk, 'A')
                    when sk % 4 = 2 then concat('CCT', sk, 'B') else concat('Q', sk, 'X', sk) end as gene
        from (select l_suppkey % 12 as sk from {lineitem}) b""",
    "bait_complex": """
        select distinct concat('K', p_size) as complex_id,
               case when p_partkey % 2 = 0 then concat('Q', p_partkey % 12, 'X', p_partkey % 12)
                    else concat('OTHER', p_partkey) end as gene
        from {part} where p_size <= 6 and p_retailprice < 902""",
    # plates, designs, lines, pulldowns, hits
    "design": """
        select distinct cast(floor(c_custkey / 3) as bigint) as design_id,
               concat('P', lpad(cast(cast(floor(c_custkey / 3) as bigint) % 25 as string), 4, '0')) as plate_id,
               concat(substr('ABCDEFGH', cast(cast(floor(c_custkey / 3) as bigint) % 8 as int) + 1, 1),
                      lpad(cast(cast(floor(c_custkey / 24) as bigint) % 12 + 1 as string), 2, '0')) as well_id,
               concat('G', cast(floor(c_custkey / 3) as bigint)) as target_name,
               concat('Q', cast(floor(c_custkey / 3) as bigint)) as uniprot_id,
               case cast(floor(c_custkey / 3) as bigint) % 4 when 0 then 'kinase' when 1 then 'transport'
                    when 2 then 'control' else null end as family
        from {customer}""",
    "line": """
        select c_custkey as line_id, cast(floor(c_custkey / 3) as bigint) as design_id,
               cast(1 + c_custkey % 3 as int) as sort_count,
               case when c_custkey < 10 then null else cast(floor(c_custkey / 10) as bigint) end as parent_id,
               case when c_custkey < 10 then 'PROGENITOR' when c_custkey % 7 = 0 then 'MONOCLONAL'
                    else 'POLYCLONAL' end as line_type, c_acctbal as sort_score
        from {customer}""",
    "pulldown": """
        select o_orderkey as pulldown_id, o_custkey as line_id,
               concat('P', lpad(cast(o_orderkey % 40 as string), 3, '0')) as plate,
               case o_orderstatus when 'F' then true when 'O' then false else null end as display_flag
        from {orders}""",
    "hit": """
        select l_orderkey * 1000000 + l_partkey as hit_id, l_orderkey as pulldown_id, l_partkey as group_id,
               max(l_quantity) / 2.5 as pval, round((max(l_discount) - 0.04) * 100, 2) as enrichment,
               max(l_quantity) > 40 as is_significant,
               max(l_quantity) > 30 and max(l_quantity) <= 40 as is_minor,
               round(max(l_tax) * 5, 2) as interaction_stoich, max(l_extendedprice) / 10000 as abundance_stoich
        from {lineitem} group by l_orderkey, l_partkey""",
    "protein_group": """
        select p_partkey as group_id,
               case when p_partkey % 5 = 0 then concat('Q', p_partkey, '-2;Q', p_partkey + 1)
                    else concat('Q', p_partkey) end as uniprot_ids,
               case when p_partkey % 5 = 0 then concat('G', p_partkey, ';G', p_partkey + 1)
                    else concat('G', p_partkey) end as gene_names
        from {part}""",
    "uniprot": """
        select concat('Q', p_partkey) as uniprot_id,
               concat('G', p_partkey, ' ', upper(substr(p_brand, 1, 5)), p_partkey % 9, ' ', upper(p_type)) as gene_names,
               concat(p_name, ' (', p_brand, ') [', p_type, ']') as protein_names,
               case when p_partkey % 17 = 0 then null
                    else concat('ENSG', lpad(cast(cast(floor(p_partkey / 2) as bigint) as string), 11, '0')) end as ensg_id,
               case when p_partkey % 3 = 0 then null when p_partkey % 3 = 1 then 'NaN'
                    else repeat(concat('FUNCTION: ', p_type, ' (PubMed:', p_partkey, '). '), p_size % 4 + 1) end as annotation
        from {part}""",
    # imaging: fields of view, tagged results, annotations
    "fov": """
        select cast(floor(event_id / 5) as bigint) as fov_id, min(user_id) as line_id,
               concat('PML', lpad(cast(min(user_id) % 60 as string), 4, '0')) as pml_id,
               min(event_id) % 7 as site_num
        from {events} group by 1""",
    "fov_result": """
        select event_id as result_id, cast(floor(event_id / 5) as bigint) as fov_id, event_type as kind,
               case when value > 100 then null else round(value / 100, 4) end as score, props as data
        from {events}""",
    "annotation": """
        select l.doc_id as entity_id,
               concat('["', d.lang, '_', d.n_chars % 3 + 1, '","', d.source, '"',
                      case when l.quality = 1 then ',"publication_ready"' else '' end,
                      case when l.toxic = 1 then ',"no_gfp"' else '' end, ']') as categories
        from {labels} l join {documents} d on l.doc_id = d.doc_id""",
    # flow events with four channels
    "cells": """
        select event_type as plate, user_id as well, event_id as cell_id, value as fitc,
               8000 + event_id % 2500 as fsc_a, 220 + event_id % 191 as fsc_w, 8300 + event_id % 900 as ssc_a
        from {events}""",
    # image pages and pixel slices
    "page": """
        select conv_id as fov_id, turn as slice_ind, role as channel, length(text) as n_chars,
               cast(length(text) % 5 as double) as exposure_time from {conversations}""",
}

# pixel slices are arrays, so the two dialects differ in how they build them:
# 2 channels x 4 z x 2 rows x 4 columns per field
SLICES_SPARK = """
    select vec_id as fov_id, k div 8 as channel, k div 2 % 4 as z, k % 2 as row,
           transform(slice(embedding, k * 4 + 1, 4), x -> cast(floor((cast(x as double) + 1) * 1000) as int)) as pixels
    from (select vec_id, embedding, explode(sequence(0, 15)) as k from {embeddings}) q"""
PIXELS_DUCK = """
    select vec_id as fov_id, cast(floor(pos / 32) as bigint) as channel, cast(floor(pos / 8) as bigint) % 4 as z,
           cast(floor(pos / 4) as bigint) % 2 as row, pos % 4 as col, cast(floor((cast(v as double) + 1) * 1000) as int) as pixel
    from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from {embeddings}) p"""
VECTORS_SPARK = """
    select vec_id, label, p.pos as dim, cast(p.v as double) as v
    from (select vec_id, label, posexplode(embedding) as (pos, v) from {embeddings}) p"""
VECTORS_DUCK = """
    select vec_id, label, cast(pos as int) as dim, cast(v as double) as v
    from (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos
          from {embeddings}) p"""

SPARK_VIEWS = {**VIEWS, "slices": SLICES_SPARK, "vectors": VECTORS_SPARK}
DUCK_VIEWS = {**VIEWS, "pixels": PIXELS_DUCK, "vectors": VECTORS_DUCK}

_NAME = re.compile(r"\{([a-z]\w*)\}")


class Tables:
    """Attribute access to base tables (parquet) and views (lazy SQL) of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in SPARK_VIEWS:
                self._made[name] = self.sql(SPARK_VIEWS[name])
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        needed = {n: getattr(self, n) for n in sorted(set(_NAME.findall(text)))}
        return self.spark.sql(text, **needed)


def with_views(text: str) -> str:
    """Expand ``{view}`` references into common table expressions for the checking engine."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for n in _NAME.findall(sql):
            if n in DUCK_VIEWS and n not in order:
                visit(DUCK_VIEWS[n])
                order.append(n)

    visit(text)
    plain = _NAME.sub(r"\1", text).strip()
    if not order:
        return plain
    ctes = [f"{n} as ({_NAME.sub(r'\1', DUCK_VIEWS[n]).strip()})" for n in order]
    recursive = ""
    m = re.match(r"(?is)with\s+(recursive\s+)?", plain)
    if m:
        recursive = "recursive " if m.group(1) else ""
        return f"with {recursive}{', '.join(ctes)}, {plain[m.end():]}"
    return f"with {', '.join(ctes)} {plain}"
