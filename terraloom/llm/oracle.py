"""DuckDB SQL for the registered queries that SQL can express.

The rest (restored texts, library tokenizers, cosine of weighted words over lines, exact components)
is held against brute force in tests/llm.
"""

from __future__ import annotations

from terraloom.llm import divergence, line_frequency, mixing, secrets

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _mix() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint as size
  from documents
), per_source as (
  select source, sum(size)::bigint as source_size from sized group by source
), turns as (
  select *, row_number() over (order by source nulls last) as turn from per_source
), weighed as (
  select *, [{weights}][((turn - 1) % {len(mixing.WEIGHTS)} + 1)::int] as weight,
    source_size * {mixing.MOST} as most_words
  from turns
), levels as (
  select *,
    ((sum(source_size) over ()) * {mixing.SHARE}::double
      - coalesce(sum(most_words) over (order by most_words / weight, turn
          rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by most_words / weight, turn
          rows between current row and unbounded following) as level
  from weighed
), goals as (
  select source, source_size,
    coalesce(least(most_words::double,
      weight * max(case when most_words / weight >= level then level end) over ()),
      most_words::double) as target,
    ('0x' || substr(md5({_quoted(mixing.SEED + "|")} || coalesce('=' || source, '')), 1, 8))::bigint
      / 4294967296.0::double as shift
  from levels
), ranked as (
  select *, row_number() over (partition by source
    order by size, coalesce(((doc_id % {mixing.SALTS}) + {mixing.SALTS}) % {mixing.SALTS}, 0), doc_id) as place
  from sized
), drawn as (
  select doc_id, size, source_size, target, place, shift,
    case when source_size = 0 then 0 else target / source_size end as expected
  from ranked r join goals g on r.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  ((floor(place * expected + shift) - floor((place - 1) * expected + shift))::bigint * size)::bigint as taken
from drawn
"""


def _lines() -> str:
    return rf"""
with docs as (
  select row_number() over () as row_id, doc_id, source, coalesce(text, '') as text from documents
), counted as (
  select row_id, doc_id, source, regexp_extract_all(text, '{_WORD}') as words,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as raw
  from docs
), placed as (
  select row_id, unnest(range(1, len(words) - 1)) as place, words from counted where len(words) >= 3
), windows as (
  select row_id, place, words[place] || ' ' || words[place + 1] || ' ' || words[place + 2] as three from placed
), repeated as (
  select row_id, place from windows qualify count(*) over (partition by row_id, three) > 1
), covered as (
  select row_id, count(distinct word)::bigint as n
  from (select row_id, unnest([place, place + 1, place + 2]) as word from repeated) group by row_id
), lines as (
  select row_id, doc_id, source, line,
    lower(array_to_string(regexp_extract_all(line, '{_WORD}'), ' ')) as normal,
    len(regexp_extract_all(line, '{_WORD}')) as words
  from (select row_id, doc_id, source, unnest(raw) as line from counted)
), frequent as (
  select source, normal from lines group by source, normal
  having count(distinct coalesce(doc_id, -1 - row_id)) > {line_frequency.MAX_DOCS}
), removed as (
  select row_id, sum(words)::bigint as n from lines l
  where exists (select 1 from frequent f where f.normal = l.normal and f.source is not distinct from l.source)
  group by row_id
), joined as (
  select doc_id, len(words)::bigint as n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars, n_symbols,
    (len(raw) - len(list_distinct(raw)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(r.n, 0)::bigint as n_removed_words
  from counted left join covered c using (row_id) left join removed r using (row_id)
), judged as (
  select *, n_words < {line_frequency.LEAST_WORDS}
    or 100 * n_repeat_words > {line_frequency.MOST_REPEATED} * n_words as base_failed
  from joined
)
select *, not base_failed
  and 100 * (n_words - n_removed_words) >= {line_frequency.LEAST_LEFT} * n_words as kept
from judged
"""


def _secrets() -> str:
    """Parts by running sums of gaps and matches; links by comparing all parts of a text.

    RE2 has no look-around: identifiers and keys are whole runs of their characters that pass.
    """
    assign = secrets.ASSIGN.replace("(?i:", "(?:(?i)")
    group = secrets.ASSIGN.replace("(?i:", "(?:(?i)")
    kinds = {
        "assign": (assign, f"length(regexp_extract(m, {_quoted(group)}, 1)) >= 12"),
        "access": (secrets.ACCESS, "length(m) >= 18"),
        "hex": ("[0-9a-f]+", "length(m) >= 16"),
        "id": (
            "[A-Za-z0-9]+",
            "regexp_full_match(m, '[A-Z][A-Z0-9]{11,}') and regexp_matches(m, '[0-9]')",
        ),
        "key": (
            "[A-Za-z0-9+/]+",
            "length(m) >= 32 and regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')",
        ),
        # A name that starts within a word starts within one that failed as a whole.
        "endpoint": (secrets.ENDPOINT.replace("(?<![a-z0-9-])", ""), f"regexp_matches(m, {_quoted(secrets.HOST)})"),
    }
    parts = " union all ".join(
        f"""select row_id, {turn} as turn, '{kind}' as kind, m, stop, {passes} as ok from (
          select row_id, m, sum(length(g) + length(m)) over (partition by row_id order by place) as stop
          from (select row_id, unnest(regexp_extract_all(text, {_quoted(pattern)})) as m,
              unnest(list_slice(string_split_regex(text, {_quoted(pattern)}), 1,
                len(regexp_extract_all(text, {_quoted(pattern)})))) as g,
              unnest(range(1, len(regexp_extract_all(text, {_quoted(pattern)})) + 1)) as place
            from docs))"""
        for turn, (kind, (pattern, passes)) in enumerate(kinds.items(), 1)
    )
    return f"""
with docs as (
  select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents
), parts as (
  select row_id, turn, kind, (stop - length(m))::int as start, stop::int as stop,
    case when kind in ('access', 'id') then 'id' when kind in ('assign', 'hex', 'key') then 'key'
      else 'endpoint' end as role
  from ({parts}) where ok
), clear as (
  select * from parts p where turn <= 3 or not exists (select 1 from parts b
    where b.row_id = p.row_id and b.turn <= 3 and b.start < p.stop and p.start < b.stop)
), linked as (
  select w.row_id, w.turn, w.kind, w.start, w.stop, w.role,
    bool_or(o.role = 'id') as has_id, bool_or(o.role = 'key') as has_key, bool_or(o.role = 'endpoint') as has_endpoint
  from clear w join clear o on o.row_id = w.row_id and abs(o.start - w.start) <= {secrets.SCOPE} and o.role <> w.role
    and (o.stop <= w.start or o.start >= w.stop)
  where w.turn > 3 group by all
), reported as (
  select row_id, turn, kind, start, stop from clear where turn <= 3
  union all select row_id, turn, kind, start, stop from linked
  where (role = 'id' and has_key) or (role = 'key' and (has_id or has_endpoint))
    or (role = 'endpoint' and has_id and has_key)
), joined as (
  select row_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, turn) filter (turn <= 3) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, turn) as spans
  from reported group by row_id
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join joined using (row_id)
"""


def _near(words: int = 3, percent: int = 85) -> str:
    """All pairs that share a shingle, and components by walking the links."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{_WORD}') as words
  from documents
), shingles as (
  select distinct doc_id, array_to_string(list_slice(words, place, place + {words - 1}), ' ') as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - {words - 1}, 1) + 1)) as place
    from docs where len(words) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), links as (
  select a, b from pairs p join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * p.n >= {percent} * (x.n + y.n - p.n)
), both_ways as (
  select a, b from links union all select b, a from links
), reached as (
  select a, b from both_ways union select r.a, l.b from reached r join both_ways l on l.a = r.b
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from (select d.doc_id, s.n, least(d.doc_id, coalesce((select min(b) from reached r where r.a = d.doc_id), d.doc_id)) as component_id
  from docs d left join sizes s on s.doc_id = d.doc_id)
"""


def _search(k: int = 20) -> str:
    return f"""
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from usable a join usable b on a.vec_id <> b.vec_id and len(a.q) = len(b.q)
  where a.vec_id % 20 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= {k}
"""


def _divergence() -> str:
    share = f"1 + ({divergence.WHOLE}::hugeint * (n + 1)) // size"
    return rf"""
with docs as (
  select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), words as (
  select row_id, lang, source, unnest(terms) as term from docs
), kept as (
  select lang, term from words group by lang, term having count(distinct row_id) >= {divergence.LEAST_DOCS}
), vocabulary as (
  select lang, count(*) as v from kept group by lang
), counts as (
  select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all
), sums as (
  select lang, source, sum(n) as n_all from counts group by all
), groups as (
  select lang, source, coalesce(v, 0) as v, coalesce(n_all, 0) + coalesce(v, 0) as size
  from (select distinct lang, source from docs)
  left join vocabulary using (lang) left join sums using (lang, source)
), shares as (
  select lang, source, term, coalesce(n, 0) as n, {share.replace("n + 1", "coalesce(n, 0) + 1")} as p
  from groups join kept using (lang) left join counts using (lang, source, term)
), in_lang as (
  select lang, term, {share} as q
  from (select lang, term, sum(n) as n from counts group by all)
  join (select lang, max(v) + sum(size - v) as size from groups group by lang) using (lang)
), pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint
  from shares join in_lang using (lang, term) where n > 0 and p > q
)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
from parts qualify part = 'pair' or rank <= {divergence.TOP_TERMS}
"""


def statements() -> dict[str, str]:
    return {
        "op2_source_mix": _mix(),
        "op3_line_frequency": _lines(),
        "op4_secret_links": _secrets(),
        "op7_minhash_dedup": _near(),
        "op8_top_k": _search(),
        "op11_source_divergence": _divergence(),
    }
