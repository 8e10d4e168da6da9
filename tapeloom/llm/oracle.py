"""SQL twins (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

MIXING_SQL = r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    case when length(text) > 0 then greatest(0.1, 1.0::double - (length(text) - length(translate(text, '#*$%&|<>!', ''))) * 10.0::double / length(text)) else 0.1 end as quality,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents
), sizes as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from docs group by source
), capped as (
  select *, [5.0, 2.0, 1.0][(rank % 3)::int + 1]::double as w, source_size * 3.0::double as cap from sizes
), levels as (
  select *, cap / w as ratio,
    (sum(source_size) over ()::double - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by cap / w, rank rows between current row and unbounded following) as level
  from capped
), targets as (
  select source, source_size, case when ratio <= level then cap else (select max(level) from levels where ratio > level) * w end as target from levels
), ordered as (
  select d.doc_id, d.source, d.size, t.source_size, t.target,
    case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint as epochs,
    sum(d.size) over (partition by d.source order by -ln(d.u) / d.quality, d.doc_id nulls last, d.size rows unbounded preceding) - d.size as before
  from docs d join targets t on d.source is not distinct from t.source
)
select doc_id, source, size, source_size, target,
  (size * (epochs + case when before + size / 2.0::double <= target - epochs * source_size then 1 else 0 end))::bigint as taken
from ordered
"""


def url_trust_sql(rules, steps: int = 12, damping: float = 0.85, threshold: float = 0.075) -> str:
    host = r"regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1)"
    low = "translate(" + host + ", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fit, verdict = "null::varchar", "null::varchar"
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fit = f"case when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.name}' else {fit} end"
        verdict = f"case when rule = '{r.name}' then '{r.verdict}' else {verdict} end"
    ctes = [
        f"parts as (select page_id, html, coalesce({low.format('url')}, '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages)",
        f"fitted as (select *, {fit} as rule from parts)",
        f"ruled as (select *, {verdict} as by_rule from fitted)",
        r"""found as (select host as src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"''\s>]+)', 1)) as u from ruled)""",
        f"pairs as (select src, {low.format(chr(39) + 'x:' + chr(39) + ' || regexp_replace(u, ' + chr(39) + '^[^/]*:' + chr(39) + ', ' + chr(39) * 2 + ')')} as dst from found)",
        "links as (select src, dst, count(*) as links from pairs where src <> '' and dst <> '' and src <> dst group by 1, 2)",
        "seeds as (select host, count(*) filter (where by_rule = 'allow') / count(*) as allowed, count(*) filter (where by_rule = 'block') / count(*) as blocked from ruled where host <> '' group by 1)",
    ]
    for name, seed, src, dst in (("trust", "allowed", "src", "dst"), ("distrust", "blocked", "dst", "src")):
        ctes.append(f"{name}_edges as (select {src} as src, {dst} as dst, links / sum(links) over (partition by {src}) as share from links)")
        ctes.append(f"{name}_0 as materialized (select host, {1 - damping!r} * {seed} as rank from seeds)")
        for k in range(steps):
            ctes.append(
                f"{name}_{k + 1} as materialized (select host, sum(rank) as rank from (select host, {1 - damping!r} * {seed} as rank from seeds"
                f" union all select e.dst, {damping} * r.rank * e.share from {name}_edges e join {name}_{k} r on e.src = r.host) group by host)"
            )
    return "with " + ",\n".join(ctes) + f"""
select page_id, r.host, path, rule,
  coalesce(by_rule, case when coalesce(d.rank, 0) - coalesce(t.rank, 0) >= {threshold} then 'block' else 'allow' end) as verdict
from ruled r left join trust_{steps} t on r.host = t.host left join distrust_{steps} d on r.host = d.host
"""


QUALITY_SQL = r"""
with docs as (
  select row_number() over () as k, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), windows as (
  select k, p, array_to_string(words[p:p + 7], ' ') as w from (select k, words, unnest(range(1, len(words) - 6)) as p from docs)
), twice as (
  select k, p from windows qualify count(*) over (partition by k, w) > 1
), covered as (
  select k, count(distinct q) as n_repeat_words from (select k, unnest(range(p, p + 8)) as q from twice) group by k
), counted as (
  select doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(lines) as n_lines, length(text) - length(translate(text, '!?', '')) as n_shouts,
    len(list_filter(words, lambda w: strlen(w) > 1 and regexp_matches(w, '[A-Z]') and not regexp_matches(w, '[a-z]'))) as n_capitals,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) as n_stutters,
    len(list_filter(words, lambda w: regexp_matches(w, '[A-Za-z\x{80}-\x{10FFFF}]'))) as n_lettered
  from docs left join covered using (k)
), based as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (
    100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 50 * n_lines or word_chars < 2 * n_words or word_chars > 14 * n_words
    or 100 * n_shouts > 30 * n_words or 100 * n_stutters > 30 * n_words or 100 * n_capitals > 50 * n_words or 100 * n_lettered < 60 * n_words) as kept
from based
"""


_CRC = "list_reduce(flatten(list_transform({0}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end, 4294967295::bigint)"


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    pairs = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i::int, 2))::bigint)"
    return f"xor({_CRC.format(pairs)}, 4294967295::bigint)"


def merkle_sql(fan: int = 8, height: int = 9) -> str:
    """``height`` levels hold trees of fan ** height leaves."""
    field = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')".format
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"leaves as (select doc_id, coalesce('=' || lang, '-') as g, sha256({head} || {field('text')}) as leaf, sha256({head} || {field(small)}) as changed, {crc32_sql('doc_id::varchar')} as crc from documents)",
        "numbered as (select *, case when crc % 3 = 0 then changed else leaf end as tampered, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as total from leaves)",
        "low_0 as (select g, pos, total, leaf as digest from numbered)",
    ]

    def tree(name: str) -> None:
        for k in range(height):
            ctes.append(
                f"{name}_{k + 1} as materialized (select g, pos // {fan} as pos, (any_value(total) + {fan - 1}) // {fan} as total, sha256(string_agg(digest, '' order by pos)) as digest"
                f" from {name}_{k} where total > 1 group by g, pos // {fan} union all select * from {name}_{k} where total = 1)"
            )
            # a tree that has ended has no siblings, and its node stays as it is
            ctes.append(
                f"{name}_side_{k} as materialized (select a.g, a.pos, a.total > 1 as rising, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos < a.pos), '') as l,"
                f" coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos > a.pos), '') as r from {name}_{k} a join {name}_{k} b on a.g = b.g and a.pos // {fan} = b.pos // {fan} group by all)"
            )

    tree("low")
    ctes.append(f"named as (select '' as g, row_number() over (order by g) - 1 as pos, count(*) over () as total, digest, g as name from low_{height})")
    ctes.append("top_0 as (select g, pos, total, digest from named)")
    tree("top")
    step = "select f.* exclude (pos, node, proof), case when s.rising then f.pos // {fan} else f.pos end as pos, case when s.rising then sha256(s.l || f.node || s.r) else f.node end as node, f.proof || s.l || s.r as proof from {before} f join {side} s on {key} = s.g and f.pos = s.pos"
    ctes.append("fold_0 as (select g, doc_id, leaf, pos, tampered as node, '' as proof from numbered)")
    for k in range(height):
        ctes.append(f"fold_{k + 1} as materialized ({step.format(fan=fan, before=f'fold_{k}', side=f'low_side_{k}', key='f.g')})")
    ctes.append(f"rise_0 as (select f.g, f.doc_id, f.leaf, f.node, f.proof, n.pos, n.digest as subroot from fold_{height} f join named n on f.g = n.name)")
    for k in range(height):
        ctes.append(f"rise_{k + 1} as materialized ({step.format(fan=fan, before=f'rise_{k}', side=f'top_side_{k}', key=chr(39) * 2)})")
    return "with " + ",\n".join(ctes) + f"""
select f.doc_id, f.leaf, f.subroot, t.digest as root, sha256(f.proof) as proof_sha256, f.node as folded_root, f.node = t.digest as verified
from rise_{height} f, top_{height} t
"""


RESAMPLING_SQL = f"""
with texts as (
  select 1 as kind, doc_id, text from documents union all select 2, item_id, text from benchmark
), split as (
  select row_number() over () as k, kind, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from texts
), occurrences as (
  select k, kind, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as feature from split, (select unnest([1, 2, 3]) as n)
), features as (
  select k, kind, feature, count(*) as n from occurrences group by all
), buckets as (
  select feature, {crc32_sql('feature')} % 10000 as bucket from (select distinct feature from features)
), placed as (
  select k, kind, bucket, sum(n)::bigint as n from features join buckets using (feature) group by all
), counts as (
  select bucket, coalesce(sum(n) filter (kind = 1), 0)::bigint as s, coalesce(sum(n) filter (kind = 2), 0)::bigint as t from placed group by 1
), gains as (
  select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from counts) + 10000)::double / ((s + 1)::double * ((select sum(t) from counts) + 10000)::double)))::bigint as gain from counts
), weighed as (
  select k, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from placed join gains using (bucket) where kind = 1 group by 1
), scored as (
  select doc_id, len(w) >= 20 as able, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint::double + 0.5) / 4294967296.0)))::bigint as score
  from split left join weighed using (k) where kind = 1
), ranked as (
  select *, row_number() over (order by able desc, score desc, doc_id nulls last) as place from scored
)
select doc_id, n_features, weight, score, case when able and place <= (select count(*) filter (able) * 5 // 100 from scored) then place end::bigint as rank from ranked
"""
