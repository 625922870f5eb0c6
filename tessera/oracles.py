"""DuckDB SQL for the queries, written independently of the Spark plans: pairing by windows instead of folds, chunks by recursion."""

from __future__ import annotations

# Elements on lines of their own, line-ending elements, elements without an end tag, characters per chunk, what counts as a tag and as readable.
BLOCK_TAGS = "p div h[1-6] ul ol li blockquote table tr td th thead tbody tfoot figure figcaption header footer article section aside nav main pre details summary dl dt dd".split()
BREAK_TAGS = ["br", "hr"]
VOID_TAGS = "img br hr col meta link input base source area param track wbr keygen".split()
CHUNK_CHARS = 1000
_TAG = r"(?is)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>|</?[a-zA-Z0-9\-:]+(?:\s+[^>]*)?>|<[a-zA-Z0-9\-:]+(?:\s+[^>]*)?/>"
_READABLE = r"[a-zA-Z0-9\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}\x{00c0}-\x{024f}]"
_B, _R = "|".join(BLOCK_TAGS), "|".join(BREAK_TAGS)
_VOID = ", ".join(f"'{t}'" for t in VOID_TAGS)

_HTML = rf"""
n0 as (select page_id, regexp_replace(html, '\r\n?', chr(10), 'g') as html from pages),
n1 as (select page_id, regexp_replace(html, '(?i)\n?(<(?:{_B})\b[^>]*>)', chr(10) || '\1', 'g') as html from n0),
n2 as (select page_id, regexp_replace(html, '(?i)(</(?:{_B})\b[^>]*>)\n?', '\1' || chr(10), 'g') as html from n1),
n3 as (select page_id, regexp_replace(html, '(?i)(</?(?:{_R})\b[^>]*>)\n?', '\1' || chr(10), 'g') as html from n2),
n4 as (select page_id, regexp_replace(html, '\n\s*\n\s*\n', chr(10) || chr(10), 'g') as html from n3),
html as (select page_id, regexp_replace(html, '^\n+', '') as html from n4)"""
_LINES = rf"""{_HTML},
l0 as (select page_id, string_split(html, chr(10)) as l from html),
l1 as (select page_id, unnest(l) as line, unnest(range(len(l))) as line_idx, len(l) as n from l0),
lines as (select page_id, line_idx, line, line_idx < n - 1 as ends from l1 where not (line_idx = n - 1 and line = '')),
text as (select * from lines where regexp_matches(regexp_replace(line, '{_TAG}', '', 'g'), '{_READABLE}'))"""
_TOKENS = rf"""{_LINES},
g0 as (select page_id, line_idx, regexp_extract_all(line, '{_TAG}') as t from text),
g1 as (select page_id, line_idx, unnest(t) as tag, unnest(range(len(t))) as i from g0 where len(t) > 0),
g2 as (select *, lower(regexp_extract(tag, '^</?([a-zA-Z0-9\-:]+)', 1)) as name from g1),
g3 as (select *, case when starts_with(tag, '<!--') or name = '' or (not starts_with(tag, '</') and (ends_with(tag, '/>') or name in ({_VOID}))) then 'u' when starts_with(tag, '</') then 'c' else 'o' end as kind from g2),
p1 as (select *, sum(case kind when 'o' then 1 else -1 end) over (partition by page_id, line_idx, name order by i) as s from g3 where kind <> 'u'),
p2 as (select *, least(0, min(s) over (partition by page_id, line_idx, name order by i)) as m from p1),
p3 as (select *, coalesce(lag(m) over (partition by page_id, line_idx, name order by i), 0) as before from p2),
p4 as (select *, case when kind = 'o' then s - m else s - m + 1 end as level from p3 where not (kind = 'c' and s < before)),
p5 as (select *, lead(kind) over w as next_kind, lead(i) over w as next_i, lead(tag) over w as next_tag from p4 window w as (partition by page_id, line_idx, name, level order by i)),
pairs as (select page_id, line_idx, i as a, next_i as b, next_tag as b_tag, row_number() over (partition by page_id, line_idx order by i) as t from p5 where kind = 'o' and next_kind = 'c'),
k as (select g3.*, o.t as ot, o.b_tag, c.t as ct from g3 left join pairs o on g3.page_id = o.page_id and g3.line_idx = o.line_idx and g3.i = o.a left join pairs c on g3.page_id = c.page_id and g3.line_idx = c.line_idx and g3.i = c.b),
tokens as (select *, case when ot is not null then '<t' || ot || '>' when ct is not null then '</t' || ct || '>'
  else '<s' || row_number() over (partition by page_id, line_idx, ot is null and ct is null order by i) || '/>' end as token from k)"""
_BLOCKS = rf"""{_TOKENS},
j as (select page_id, line_idx, list(token order by i) as tokens, string_agg(token || '=' || tag || case when ot is not null then chr(31) || '</t' || ot || '>=' || b_tag else '' end, chr(31) order by i) filter (where ct is null) as mapping from tokens group by page_id, line_idx),
w as (select text.page_id, text.line_idx, line, ends, mapping, tokens, string_split_regex(line, '{_TAG}') as gaps from text left join j on text.page_id = j.page_id and text.line_idx = j.line_idx),
x as (select *, case when tokens is null then line else list_reduce(list_prepend('', list_transform(range(len(gaps)), lambda i: gaps[i + 1] || case when i < len(tokens) then tokens[i + 1] else '' end)), lambda a, b: a || b) end as whole from w),
blocks as (select page_id, line_idx, regexp_replace(whole, '^\s+|\s+$', '', 'g') as text, coalesce(mapping, '') as mapping, regexp_extract(whole, '^\s*') as indent, regexp_extract(whole, '\s*$') || case when ends then chr(10) else '' end as tail,
  row_number() over (partition by page_id order by line_idx) - 1 as block_ord, row_number() over (order by page_id, line_idx) - 1 as global_idx from x)"""
_CHUNKS = rf"""{_BLOCKS},
r(page_id, k, chunk, size) as (
  select page_id, block_ord, cast(0 as bigint), length(text) from blocks where block_ord = 0 union all
  select b.page_id, b.block_ord, r.chunk + case when r.size >= {CHUNK_CHARS} then 1 else 0 end, case when r.size >= {CHUNK_CHARS} then 0 else r.size end + length(b.text)
  from r join blocks b on b.page_id = r.page_id and b.block_ord = r.k + 1),
z as (select b.*, r.chunk, dense_rank() over (order by b.page_id, r.chunk) - 1 as chunk_id, row_number() over (partition by b.page_id, r.chunk order by b.block_ord) as n from blocks b join r on b.page_id = r.page_id and b.block_ord = r.k),
chunks as (select page_id, chunk_id, count(*) as n_blocks, string_agg('<' || n || '>' || text || '</' || n || '>', chr(10) order by n) as orig, string_agg(cast(global_idx as varchar), ',' order by n) as blocks from z group by page_id, chunk_id)"""
_ATTEMPTS = """
a as (select conv_id as chunk_id, turn as attempt, case when turn % 4 = 1 then null else text end as trans,
  case turn % 4 when 0 then 'ok' when 1 then 'api_error' when 2 then 'line_count_mismatch' else 'unbalanced_internal_t1' end as error_type from conversations),
latest as (select * from a qualify row_number() over (partition by chunk_id order by attempt desc) = 1),
book as (select doc_id as chunk_id, text as orig, coalesce(trans, '') as trans, coalesce(error_type <> 'ok', false) as is_error, error_type,
  case when error_type = 'api_error' then 'API错误' when error_type <> 'ok' then '格式错误' when coalesce(trans, '') <> '' then '已翻译' else '未翻译' end as status from documents left join latest on doc_id = chunk_id)"""
_TIDY = r"regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]*\n[ \t]*\n[ \t]*\n+', chr(10) || chr(10), 'g'), '^(\s*\n)+', ''), '(\s*\n)+$', '')"
# The fake backend's replies, block by block: number 6 of 7 chunks fails, the others are whole, lack the last block, number the first one 0, lack, double or forge an anchor.
_FAULTS = rf"""{_CHUNKS},
f0 as (select *, chunk_id % 7 as fault, count(*) over (partition by chunk_id) as size, min(case when contains(text, '</t1>') then n end) over (partition by chunk_id) as shut, min(case when contains(text, '<t1>') then n end) over (partition by chunk_id) as opened from z),
f1 as (select *, case when fault = 2 and n = 1 then 0 else n end as id, case
  when fault = 3 and n = shut then left(text, strpos(text, '</t1>') - 1) || substr(text, strpos(text, '</t1>') + 5)
  when fault = 4 and n = opened then left(text, strpos(text, '<t1>') - 1) || '<t1><t1>' || substr(text, strpos(text, '<t1>') + 4)
  when fault = 5 and n = 1 then text || '<s99/>' else text end as body from f0),
f2 as (select * from f1 where fault <> 6 and not (fault = 1 and n = size)),
f3 as (select *, list_sort(list_transform(list_filter(list_distinct(regexp_extract_all(body, '<t(\d+)>', 1)),
  lambda k: (length(body) - length(replace(body, '<t' || k || '>', ''))) / (length(k) + 3) <> (length(body) - length(replace(body, '</t' || k || '>', ''))) / (length(k) + 4)), lambda k: cast(k as bigint))) as wrong from f2),
f4 as (select *, case when id <> n then 'index_mismatch_at_' || id || '_expected_' || n when len(wrong) > 0 then 'unbalanced_internal_t' || wrong[1] end as fails from f3),
f5 as (select chunk_id, count(*) as got, string_agg('<' || id || '>' || body || '</' || id || '>', chr(10) order by n) as trans, arg_min(fails, n) filter (where fails is not null) as fails from f4 group by chunk_id),
judged as (select c.chunk_id, n_blocks, case when c.chunk_id % 7 <> 6 then coalesce(trans, '') end as trans,
  case when c.chunk_id % 7 = 6 then 'api_error' when coalesce(got, 0) <> n_blocks then 'line_count_mismatch' else coalesce(fails, 'ok') end as error_type from chunks c left join f5 on c.chunk_id = f5.chunk_id),
parsed as (select f1.*, case when (fault = 1 and n = size) or (fault = 2 and n = 1) then text else regexp_replace(body, '^\s+|\s+$', '', 'g') end as reply from f1 where fault <> 6)"""
# A block's tags put back; what its anchor </t1> stood for, if it has one.
_BACK = r"case when mapping = '' then {0} else list_reduce(list_prepend({0}, string_split(mapping, chr(31))), lambda a, m: replace(a, split_part(m, '=', 1), substr(m, strpos(m, '=') + 1))) end"
_SHUT = "coalesce(list_filter(list_transform(string_split(mapping, chr(31)), lambda m: case when starts_with(m, '</t1>=') then substr(m, 7) end), lambda x: x is not null)[1], '')"
# Block elements in order of precedence; a line's first opening tag of the first element that is closed there or later spans the lines up to that.
_ELEMENTS = ["p", "h[1-6]", "li", "blockquote", "figcaption", "dt", "dd", "summary", "pre", "text"]
_OPENERS = ", ".join(rf"lower(regexp_extract(line, '(?i)<({t})(?:\s+[^>]*)?>', 1))" for t in _ELEMENTS)
_PARAGRAPHS = rf"""{_LINES},
closers as (select distinct page_id, line_idx, lower(unnest(regexp_extract_all(line, '(?i)</([a-z]+[1-6]?)\s*>', 1))) as name from lines),
o0 as (select page_id, line_idx, [{_OPENERS}] as names from lines),
o1 as (select page_id, line_idx, unnest(names) as name, unnest(range(len(names))) as place from o0),
o2 as (select o1.page_id, o1.line_idx, place, min(closers.line_idx) as e from o1 join closers on o1.page_id = closers.page_id and o1.name = closers.name and closers.line_idx >= o1.line_idx where o1.name <> '' group by all),
o3 as (select page_id, line_idx, arg_min(e, place) as e from o2 group by all),
spans as (select lines.page_id, lines.line_idx, coalesce(e, lines.line_idx) as e from lines left join o3 on lines.page_id = o3.page_id and lines.line_idx = o3.line_idx),
walk(page_id, a, e) as (select page_id, line_idx, e from spans where line_idx = 0 union all select s.page_id, s.line_idx, s.e from walk w join spans s on s.page_id = w.page_id and s.line_idx = w.e + 1),
w1 as (select w.page_id, a, w.e, string_agg(line, chr(10) order by line_idx) as body, bool_and(ends) as whole from walk w join lines l on l.page_id = w.page_id and l.line_idx between a and w.e group by all),
paragraphs as (select page_id, a as start_line, e as end_line, body || case when whole then chr(10) else '' end as text, row_number() over (order by page_id, a) - 1 as global_idx from w1 where regexp_matches(regexp_replace(body, '{_TAG}', '', 'g'), '{_READABLE}'))"""
_TOKEN = r"</?\d+>|</?t\d+>|<s\d+/>"
_DIRECT = rf"""
l0 as (select doc_id, string_split(text, chr(10)) as l from documents),
l1 as (select doc_id, unnest(l) as line, unnest(range(len(l))) as line_idx, len(l) as n from l0),
l2 as (select doc_id, line_idx, line || case when line_idx < n - 1 then chr(10) else '' end as text from l1 where not (line_idx = n - 1 and line = '') and regexp_matches(line, '{_READABLE}')),
b as (select *, length(text) as n, row_number() over (partition by doc_id order by line_idx) - 1 as k from l2),
r(doc_id, k, chunk, size) as (
  select doc_id, k, cast(0 as bigint), cast(n as bigint) from b where k = 0 union all
  select b.doc_id, b.k, r.chunk + case when b.n >= {CHUNK_CHARS} or r.size >= {CHUNK_CHARS} or r.size + b.n > {CHUNK_CHARS} then 1 else 0 end,
    case when b.n >= {CHUNK_CHARS} or r.size >= {CHUNK_CHARS} or r.size + b.n > {CHUNK_CHARS} then b.n else r.size + b.n end
  from r join b on b.doc_id = r.doc_id and b.k = r.k + 1),
z as (select b.*, dense_rank() over (order by b.doc_id, r.chunk) - 1 as chunk_id from b join r on b.doc_id = r.doc_id and b.k = r.k)"""


def _with(parts: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{parts.strip()} {select}"


SQL: dict[str, str] = {
    "html_normalize": _with(_HTML, "select page_id, html from html"),
    "text_lines": _with(_LINES, "select page_id, line_idx, line from lines"),
    "text_blocks": _with(_LINES, "select page_id, line_idx, line from text"),
    "tag_strip": f"select page_id, regexp_replace(html, '{_TAG}', '', 'g') as text from pages",
    "readable_pages": f"select page_id, regexp_matches(regexp_replace(html, '{_TAG}', '', 'g'), '{_READABLE}') as readable from pages",
    "tag_pairs": _with(_TOKENS, "select page_id, line_idx, i, tag, token from tokens"),
    "tag_simplify": _with(_BLOCKS, "select page_id, line_idx, text, mapping, indent, tail from blocks"),
    "block_global_index": _with(_BLOCKS, "select page_id, line_idx, block_ord, global_idx from blocks"),
    "chunk_anchor": _with(_CHUNKS, "select page_id, chunk_id, n_blocks, blocks from chunks", True),
    "chunk_direct": _with(_DIRECT, r"select doc_id, chunk_id, count(*) as n_blocks, string_agg(regexp_replace(text, '[\r\n]+$', ''), chr(10) order by k) as orig from z group by doc_id, chunk_id", True),
    "prompt_render": _with(_CHUNKS, "select chunk_id, orig from chunks", True),
    "chunk_stats": _with(_CHUNKS, "select 'pages' as book_id, count(*) as n_chunks, count(distinct page_id) as n_files, cast(sum(n_blocks) as bigint) as n_blocks from chunks", True),
    "translate_identity": _with(_CHUNKS, "select chunk_id, orig as trans, 'ok' as status from chunks", True),
    "restore_line": _with(_LINES, "select page_id, line_idx, line || case when ends then chr(10) else '' end as line from text"),
    "render_replace_identity": _with(_HTML, "select page_id, html from html"),
    "render_bilingual": _with(
        _LINES,
        """select lines.page_id, string_agg(lines.line || case when t.line is null then '' when lines.ends then chr(10) || lines.line else chr(10) || lines.line end || case when lines.ends then chr(10) else '' end, '' order by lines.line_idx) as html
        from lines left join text t on lines.page_id = t.page_id and lines.line_idx = t.line_idx group by lines.page_id""",
    ),
    "validate_format": _with(_FAULTS, "select chunk_id, trans, n_blocks, error_type from judged", True),
    "parse_response": _with(_FAULTS, "select global_idx, reply as text from parsed", True),
    "revalidate": _with(_FAULTS, "select chunk_id, case when coalesce(trans, '') <> '' then error_type end as error_type from judged", True),
    "backfill_eligible": _with(_FAULTS, "select chunk_id from judged where error_type = 'ok' or starts_with(error_type, 'unbalanced_internal_')", True),
    "export_eligible": _with(_FAULTS, "select chunk_id from judged where coalesce(trans, '') <> ''", True),
    "blocks_of_chunk": _with(_CHUNKS, "select n, global_idx, replace(substring(text, 1, 100), chr(10), ' ') as preview from z where chunk_id = 3", True),
    "chunk_detail": _with(_FAULTS, rf"select j.chunk_id, j.trans, array_to_string(list_sort(list_distinct(regexp_extract_all(orig, '{_TOKEN}'))), ',') as tokens, '<s99/>' as forged from judged j join chunks c on c.chunk_id = j.chunk_id where j.chunk_id = 5", True),
    "all_done": "select * from (values ('faulty', false), ('whole', true)) as t(kind, done)",
    "epub_round_trip": r"select page_id, row_number() over (partition by page_id % 10 order by page_id desc) - 1 as file_ord, regexp_replace(html, '\r\n?', chr(10), 'g') as html from pages",
    "restore_faulty": _with(_BLOCKS, f"select page_id, line_idx, indent || {_BACK.format("replace(text, '</t1>', '')")} || {_SHUT} || tail as line from blocks"),
    "render_translated": _with(
        _FAULTS,
        f"""select lines.page_id, string_agg(case when fault = 3 and n = shut then indent || {_BACK.format("reply")} || {_SHUT} || tail else lines.line || case when lines.ends then chr(10) else '' end end, '' order by lines.line_idx) as html
        from lines left join parsed p on lines.page_id = p.page_id and lines.line_idx = p.line_idx group by lines.page_id""",
        True,
    ),
    "paragraph_blocks": _with(_PARAGRAPHS, "select page_id, start_line, end_line, text, global_idx from paragraphs", True),
    "render_direct": _with(_PARAGRAPHS, "select html.page_id, html.html || case when bool_or(p.text is not null and not ends_with(p.text, chr(10))) then chr(10) else '' end as html from html left join paragraphs p on html.page_id = p.page_id group by html.page_id, html.html", True),
    "strip_thinking": "select conv_id, turn, case turn % 3 when 0 then " + _TIDY.format("'<think>a <cot>b</cot> x' || text") + " when 1 then 'rest' else " + _TIDY.format("text") + " end as text from conversations",
    "code_fence_strip": "select conv_id, turn, trim(text, chr(10) || chr(13)) as text from conversations",
    "reply_decode": "select conv_id, turn, case when turn % 4 = 0 or (turn % 4 = 1 and text <> '') then text end as text, case when turn % 4 = 0 or (turn % 4 = 1 and text <> '') then 'ok' else 'api_error' end as status from conversations",
    "token_set": _with(_CHUNKS, rf"select chunk_id, array_to_string(list_sort(list_distinct(regexp_extract_all(orig, '{_TOKEN}'))), ',') as tokens from chunks", True),
    "forged_tokens": _with(_CHUNKS, rf"select chunk_id, array_to_string(list_sort(list_filter(['<t77>', '<s88/>'], lambda t: not contains(orig, t))), ',') as forged from chunks", True),
    "latest_result": _with(_ATTEMPTS, "select chunk_id, attempt, trans, error_type from latest"),
    "reassemble": _with(_ATTEMPTS, "select chunk_id, trans, is_error from book"),
    "resume_pending": _with(_ATTEMPTS, "select doc_id as chunk_id from documents where doc_id not in (select chunk_id from latest where error_type <> 'api_error')"),
    "status_filter": _with(_ATTEMPTS, "select chunk_id, status from book where is_error"),
    "status_counts": _with(_ATTEMPTS, "select status, count(*) as n from book group by status"),
    "keyword_search": _with(_ATTEMPTS, "select chunk_id from book where trans <> '' and (contains(lower(orig), 'the') or contains(lower(trans), 'the'))"),
    "chunk_list": _with(_ATTEMPTS, "select chunk_id, status, replace(substring(orig, 1, 50), chr(10), ' ') || '...' as preview from book"),
    "preview": "select doc_id, replace(substring(text, 1, 50), chr(10), ' ') || '...' as short, replace(substring(text, 1, 100), chr(10), ' ') as long from documents",
    "history_topk": "select cast(user_id as varchar) as api_key, event_type as api_url, event_id from (select * from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1) order by ts desc, event_id desc limit 10",
}
