"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from hopline.llm import license_scan as lic
from hopline.llm import source_mixing as mix

def mixing() -> str:
    return rf"""
with sizes as (
  select row_number() over () as rid, doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from documents),
per as (select source, sum(size)::bigint as source_size from sizes group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as rank from per),
weighed as (
  select *, ([{", ".join(f"{w}.0::double" for w in mix.WEIGHTS)}])[rank % {len(mix.WEIGHTS)} + 1] as weight, {mix.CAP}::double * source_size as cap,
    {mix.SHARE}::double * sum(source_size) over () as total from ranked),
levels as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0)) as level
  from weighed),
full_ones as (select *, cap / weight <= level as is_full from levels),
set_levels as (select *, max(case when not is_full then level end) over () as lam from full_ones),
goals as (select source, rank, source_size, total, case when is_full then cap else lam * weight end as target from set_levels),
fines as (select *, greatest(1, least({mix.BLOCK}, floor(min(case when target > 0 then target end) over () / {mix.FINE})))::bigint as fine from goals),
blocks as (
  select *, greatest(fine, ceil(total / {mix.SLOTS}))::bigint as block, greatest(fine, ceil(total / {mix.SLOTS})) > fine and target < {mix.FINE} * greatest(fine, ceil(total / {mix.SLOTS})) as exact,
    sum(target) over (order by rank rows unbounded preceding) / sum(target) over () as high,
    (sum(target) over (order by rank rows unbounded preceding) - target) / sum(target) over () as low, sum(target) over () as all_targets from fines),
slots as (select unnest(range(round(max(all_targets) / max(block))::bigint)) as slot from blocks),
points as (select slot, (slot + 0.5::double) * 0.6180339887498949::double - floor((slot + 0.5::double) * 0.6180339887498949::double) as u from slots),
mapped as (
  select slot, rank, ceil(source_size / block)::bigint as n, row_number() over (partition by rank order by slot) - 1 as r
  from points join blocks on u >= low and u < high where target > 0 and not exact),
times as (select rank, r % n as block_no, count(*) as times from mapped where r // n < {mix.CAP} group by all),
placed as (
  select s.*, b.rank, b.source_size, b.target, b.block, b.exact,
    coalesce(sum(size) over (partition by b.rank order by h, doc_id, size, rid rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from sizes s join blocks b on s.source is not distinct from b.source),
pieces as (select *, unnest(range(start // block, (start + size - 1) // block + 1)) as block_no from placed where size > 0),
taken as (
  select rid, sum((least(start + size, (p.block_no + 1) * block) - greatest(start, p.block_no * block)) * times)::bigint as taken
  from pieces p join times t on p.rank = t.rank and p.block_no = t.block_no group by rid)
select doc_id, size, source_size, target,
  case when exact and size > 0 then (round(target)::bigint // source_size) * size + greatest(0, least(size, round(target)::bigint % source_size - start)) else coalesce(taken, 0) end::bigint as taken
from placed left join taken using (rid)
"""


def sharding(limit: int) -> str:
    return f"""
with sizes as (
  select row_number() over () as rid, doc_id, strlen(coalesce(text, ''))::bigint as n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as key
  from documents),
nodes as (select rid, doc_id, n_bytes, d as depth, key >> (60 - d) as prefix from sizes, range(0, 25) t(d)),
sums as (select depth, prefix, sum(n_bytes)::bigint as shard_bytes, count(*) as shard_docs from nodes group by all),
best as (
  select rid, min(depth) as depth from nodes join sums using (depth, prefix)
  where shard_bytes <= {limit} or shard_docs = 1 group by rid)
select n.doc_id, n.n_bytes, case when n.depth = 0 then '' else substr(lpad(bin(prefix), 60, '0'), 61 - n.depth::int) end as shard,
  n.depth::int as depth, shard_bytes, shard_docs
from best join nodes n using (rid, depth) join sums using (depth, prefix)
"""


def licenses() -> str:
    values = ", ".join(f"({t}, '{label}', {str(b).lower()}, {i}, {n}, '{g}')" for t, label, b, i, n, g in lic.template_grams())
    return rf"""
with grams(template, label, is_base, pos, runs, gram) as (values {values}),
docs as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{lic.UPPER}', '{lic.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
places as (select rid, w, unnest(range(len(w) - {lic.K} + 1)) as start from docs),
hits as (
  select rid, template, label, is_base, pos, runs, start from
    (select rid, start, w[start + 1] || ' ' || w[start + 2] || ' ' || w[start + 3] as gram from places) join grams using (gram)),
votes as (
  select rid, template, label, is_base, runs, start - pos as diagonal, list(distinct pos) as seen from hits group by rid, template, label, is_base, runs, start - pos),
marked as (
  select *, is_base and len(seen) = runs as full_one,
    coalesce((diagonal - lag(diagonal) over (partition by rid, template order by diagonal) > {lic.GAP})::int, 0) as fresh from votes),
spans as (select *, sum(fresh) over (partition by rid, template order by diagonal) as span from marked),
stretches as (
  select *, len(list_distinct(flatten(list(seen) over (partition by rid, template, span order by diagonal / (runs + {lic.GAP})::double range between current row and 0.999999::double following)))) / runs::double as reach from spans),
merged as (
  select rid, template, label, is_base, span, max(reach) as cover,
    count(*) filter (full_one) as places, min(diagonal) filter (full_one) as first, max(diagonal) filter (full_one) as last
  from stretches group by rid, template, label, is_base, span),
per as (
  select rid, sum(places)::bigint as n_base, min(first) as first_word, max(last) as last_word, max(cover) as score,
    string_agg(distinct label, ',' order by label) filter (places > 0) as base_labels,
    string_agg(distinct label, ',' order by label) filter (places > 0 or (not is_base and cover >= {lic.COVER})) as labels
  from merged group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from docs left join per using (rid)
"""


def centroids(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Full scans in whole numbers; for components that keep distances within 64 bits."""
    steps = [
        f"""
vectors as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
  from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
starts as (select v, row_number() over (order by sha256('{seed}:' || vec_id::varchar) nulls last, v) - 1 as cluster from vectors),
at0 as (select cluster, v as place from starts where cluster < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""
near{i} as (
  select rid, min(list_sum(list_transform(range(1, {dims + 1}), lambda j: (v[j] - place[j]) * (v[j] - place[j])))::hugeint * 1000000 + cluster) as best
  from vectors, at{i} group by rid),
own{i} as (select vec_id, v, (best % 1000000)::bigint as cluster, (best // 1000000)::bigint as distance from near{i} join vectors using (rid))"""
        )
        if i < rounds:
            steps.append(
                f"""
parts{i} as (select cluster, j, sum(v[j])::hugeint as s, count(*)::hugeint as n from own{i}, range(1, {dims + 1}) r(j) group by cluster, j),
moved{i} as (select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as place from parts{i} group by cluster),
at{i + 1} as (select cluster, coalesce(moved{i}.place, at{i}.place) as place from at{i} left join moved{i} using (cluster))"""
            )
    return (
        "with "
        + ",".join(steps)
        + f"""
select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(place, ',')) as centroid_sha256
from own{rounds} join at{rounds} using (cluster)"""
    )
