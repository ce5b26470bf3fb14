"""SQL of the operators that iterate: one block of common table expressions a round or level, as DuckDB runs it."""

from __future__ import annotations


def clustering_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Lloyd's rounds by plain squared differences."""
    parts = [
        f"""
kept as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c, v as m from kept order by sha256('{seed}:' || vec_id) limit {k})"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} as materialized (select vec_id, v, min_by(c, d * {k} + c) as c, min(d) as d from (
  select vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, c{i}) group by all)""")
        if i < rounds:
            parts.append(f"""
s{i} as (select c, pos, sum(x) as s, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as pos from a{i}) group by all),
c{i + 1} as materialized (select c, coalesce(l, m) as m from c{i} left join (
  select c, list(((s - (((s % n) + n) % n)) // n)::bigint order by pos) as l from s{i} group by c) using (c))""")
    return f"""with {",".join(parts)}
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (c)"""


#: crc32 of a decimal number's text, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}::varchar, ''), lambda x: ord(x)::bigint)),
  lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def merkle_sql(levels: int = 14, upper: int = 10) -> str:
    """Levels of runs of three, and each leaf's way up, one block a level: 3 ** levels leaves a source and 3 ** upper sources."""

    def enc(column: str) -> str:
        return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    parts = [
        f"""
docs as (select doc_id, source, {leaf("text")} as leaf, case when {CRC.format("doc_id")} % 2 = 0 then {leaf("replace(text, chr(10), '')")} end as changed from documents),
p0 as materialized (select row_number() over () as r, doc_id, leaf, dense_rank() over (order by source nulls first) as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as spot, coalesce(changed, leaf) as f, '' as proof from docs),
t0 as (select g, spot, leaf as h, count(*) over (partition by g) as n from p0)"""
    ]

    def climb(p: str, t: str, depth: int, first: int) -> None:
        for i in range(first, first + depth):
            parts.append(f"""
r{t}{i} as materialized (select g, spot // 3 as spot, list(h order by spot) as hs, (n + 2) // 3 as n from {t}{i} where n > 1 group by all),
{t}{i + 1} as materialized (select g, spot, sha256(array_to_string(hs, '')) as h, n from r{t}{i} union all select * from {t}{i} where n = 1),
{p}{i + 1} as materialized (select r, doc_id, leaf, p.g, p.spot // 3 as spot,
  case when hs is null then f else sha256(array_to_string(hs[1:p.spot % 3], '') || f || array_to_string(hs[p.spot % 3 + 2:], '')) end as f,
  case when hs is null then proof else proof || array_to_string(hs[1:p.spot % 3], '') || array_to_string(hs[p.spot % 3 + 2:], '') end as proof
  from {p}{i} p left join r{t}{i} q on p.g = q.g and p.spot // 3 = q.spot)""")

    climb("p", "t", levels, 0)
    parts.append(f"""
q0 as (select r, doc_id, leaf, 0 as g, g - 1 as spot, f, proof from p{levels}),
u0 as (select 0 as g, g - 1 as spot, h, count(*) over () as n from t{levels})""")
    climb("q", "u", upper, 0)
    return f"""with {",".join(parts)}
select q.doc_id, q.leaf, t.h as subroot, u.h as root, sha256(q.proof) as proof_sha256, q.f as folded_root, q.f = u.h as verified
from q{upper} q join p0 on p0.r = q.r join t{levels} t on t.g = p0.g, u{upper} u"""
