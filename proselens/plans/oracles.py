"""The queries in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from .. import constants as C
from ..functions.text import normal_form
from .queries import META_LAYERS, META_WEIGHTS, PARTS


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "(" + ", ".join(_q(x) for x in xs) + ")"


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sentences(x: str) -> str:
    cut = rf"string_split(regexp_replace({strip(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {_q(C.WORD)})"


def lower_words(x: str) -> str:
    return f"list_transform({words(x)}, lambda w: lower(w))"


def vowels(x: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(C.VOWELS)}))"


def syllables(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE greatest(1, {vowels(f"regexp_replace({x}, {_q(C.NOT_SPOKEN)}, ' ', 'g')")}) END"


def pos(w: str) -> str:
    ends = " OR ".join(f"{w} LIKE '%{e}'" for e in C.ADJECTIVE_ENDS)
    return (
        f"CASE WHEN {w} IN {_list(C.PRONOUNS)} THEN 'pron' WHEN {w} IN {_list(C.DETERMINERS)} THEN 'det' WHEN {w} IN {_list(C.CONJUNCTIONS)} THEN 'cconj' WHEN {w} IN {_list(C.ADPOSITIONS)} THEN 'adp' "
        f"WHEN {w} LIKE '%ly' THEN 'adv' WHEN {w} LIKE '%ed' OR {w} LIKE '%ing' THEN 'verb' WHEN {ends} THEN 'adj' ELSE 'noun' END"
    )


# --- style

_TTR = "CASE WHEN n_words = 0 THEN 0.0 ELSE len(list_distinct(toks)) / n_words END"
_MATTR = f"CASE WHEN n_words <= 50 THEN {_TTR} ELSE list_sum(list_transform(range(1, n_words - 48), lambda i: len(list_distinct(list_slice(toks, i, i + 49))))) / (50 * (n_words - 49)) END"


def _style(source: str, keep: str, sents: str) -> str:
    """CTEs ending in ``style``: all features of rows (keep, sents) of source."""
    tags = "\n".join(f", CASE WHEN n_words = 0 THEN 0.0 ELSE len(list_filter(tags, lambda t: t = '{t}')) / n_words END AS pos_{t}" for t in C.POS_TAGS)
    return f"""
s0 AS (SELECT {keep}, {sents} AS sents FROM {source}),
s1 AS (SELECT {keep}, len(sents) AS n_sent, coalesce(array_to_string(sents, ' '), '') AS sub, list_transform(sents, lambda s: len({words("s")})) AS lens FROM s0),
s2 AS (SELECT *, {lower_words("sub")} AS toks FROM s1),
s3 AS (SELECT *, len(toks) AS n_words, list_transform(toks, lambda w: {pos("w")}) AS tags, {syllables("sub")} AS syl, len(list_filter(toks, lambda w: {vowels("w")} >= 3)) AS hard,
  coalesce(list_avg(lens), 0.0) AS mu FROM s2),
s4 AS (SELECT *, sqrt(coalesce(list_avg(list_transform(lens, lambda x: (x - mu) * (x - mu))), 0.0)) AS sd, n_sent = 0 OR n_words = 0 AS none FROM s3),
style AS (SELECT {keep}, n_sent, n_words, toks, CASE WHEN n_words = 0 THEN 0.0 ELSE list_sum(list_transform(toks, lambda w: length(w))) / n_words END AS avg_word_len, {_TTR} AS ttr {tags},
  CASE WHEN n_sent <= 1 THEN 0.0 ELSE (sd - mu) / (sd + mu + 1e-12) END AS burst_b, CASE WHEN n_sent <= 1 THEN 0.0 ELSE sd / (mu + 1e-12) END AS burst_cv, mu AS mean_slen,
  CASE WHEN none THEN 0.0 ELSE 206.835 - 1.015 * (n_words / n_sent) - 84.6 * (syl / n_words) END AS flesch,
  CASE WHEN none THEN 0.0 ELSE 0.39 * (n_words / n_sent) + 11.8 * (syl / n_words) - 15.59 END AS fk_grade,
  CASE WHEN none THEN 0.0 ELSE 0.4 * (n_words / n_sent + 100.0 * (hard / n_words)) END AS gunning_fog FROM s4)"""


_DOC_STYLE = "WITH " + _style("documents", "doc_id", sentences("text"))
_POS = [f"pos_{t}" for t in C.POS_TAGS]

# --- windows, probabilities and labels

_WINDOWS = f"""
d AS (SELECT doc_id, {sentences("text")} AS ss FROM documents),
win AS (SELECT doc_id, k AS window_id, k * 2 AS span_start, least(k * 2 + 3, len(ss)) - 1 AS span_end, list_slice(ss, k * 2 + 1, k * 2 + 3) AS ws
  FROM (SELECT *, unnest(CASE WHEN len(ss) = 0 THEN [] ELSE range(0, CAST(ceil(greatest(len(ss) - 3, 0) / 2.0) AS BIGINT) + 1) END) AS k FROM d)),
wt AS (SELECT *, array_to_string(ws, ' ') AS text_raw FROM win)"""
_SCORE = """e AS (SELECT *, burst_cv * 2.0 - 0.5 AS a, avg_word_len * 0.3 - 1.0 AS b, ttr - 0.5 AS c FROM style),
f AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM e),
pr AS (SELECT *, ea / (ea + eb + ec) AS p_human, eb / (ea + eb + ec) AS p_ai, ec / (ea + eb + ec) AS p_paraphrased_ai FROM f)"""
_PROBS = f"""WITH {_WINDOWS}, {_style("wt", "doc_id, window_id, span_start, span_end", sentences("text_raw"))}, {_SCORE}"""
_P = ("p_human", "p_ai", "p_paraphrased_ai")
_LABEL = "CASE WHEN p_human >= p_ai AND p_human >= p_paraphrased_ai THEN 'human' WHEN p_ai >= p_paraphrased_ai THEN 'ai' ELSE 'paraphrased_ai' END"
_SMOOTH = _PROBS + ", sm AS (SELECT doc_id, window_id, span_start, span_end, " + ", ".join(f"{p} AS {p}_raw, avg({p}) OVER w AS {p}" for p in _P) + " FROM pr WINDOW w AS (PARTITION BY doc_id ORDER BY window_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"
_LABELLED = _SMOOTH + f", lw AS (SELECT *, {_LABEL} AS window_label, greatest(p_human, p_ai, p_paraphrased_ai) AS window_confidence FROM sm)"
_SENTENCES = _LABELLED + f"""
, x AS (SELECT doc_id, unnest(range(span_start, span_end + 1)) AS sentence_id, p_human, p_ai, p_paraphrased_ai FROM lw),
m AS (SELECT doc_id, sentence_id, {", ".join(f"avg({p}) AS {p}" for p in _P)} FROM x GROUP BY ALL),
se AS (SELECT doc_id, unnest(range(0, len(ss))) AS sentence_id, unnest(ss) AS text FROM d),
sp AS (SELECT se.doc_id, se.sentence_id, se.text, coalesce(p_human, 1.0) AS p_human, coalesce(p_ai, 0.0) AS p_ai, coalesce(p_paraphrased_ai, 0.0) AS p_paraphrased_ai FROM se LEFT JOIN m USING (doc_id, sentence_id)),
js AS (SELECT *, {_LABEL} AS label, greatest(p_human, p_ai, p_paraphrased_ai) AS confidence FROM sp)"""


def _coverage(x: str) -> str:
    return f"avg(CASE WHEN window_label = '{x}' AND window_confidence >= {C.CONFIDENCE_THRESHOLD} THEN 1.0 ELSE 0.0 END)"


_SUMMARY = f"""SELECT doc_id, count(*) AS num_windows, {_coverage("ai")} AS coverage_ai, {_coverage("paraphrased_ai")} AS coverage_paraphrased, 0.0 AS max_sim, 0.0 AS detectgpt_mean, {", ".join(f"avg({p}) AS {p}" for p in _P)} FROM lw GROUP BY doc_id"""


def _verdict(p_ai: str, p_para: str) -> str:
    para = f"{p_para} >= 0.5 OR (coverage_paraphrased >= {C.COVERAGE_PARA_THRESHOLD} AND max_sim >= {C.TAU_SEMANTIC})"
    ai = f"{p_ai} >= 0.5 OR (coverage_ai >= {C.COVERAGE_AI_THRESHOLD} AND detectgpt_mean <= {C.DETECTGPT_THRESHOLD})"
    return f"CASE WHEN {para} THEN 'paraphrased_ai' WHEN {ai} THEN 'ai' ELSE 'human' END"


# --- papers, blocks and headings

_PART = "[" + ", ".join(_q(p).replace("\n", "' || chr(10) || '") for p in PARTS) + "][doc_id % 10 + 1]"
_NN = "chr(10) || chr(10)"
_PAPERS = f"papers AS (SELECT doc_id // 10 AS doc_id, string_agg({_PART} || {_NN} || text, {_NN} ORDER BY doc_id) AS text FROM documents GROUP BY doc_id // 10)"
_CHUNKS = rf"""{_PAPERS},
c0 AS (SELECT doc_id, unnest(range(0, len(r))) AS chunk, unnest(r) AS raw FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS r FROM papers)),
c1 AS (SELECT doc_id, chunk, list_filter(list_transform(string_split(raw, chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS lines FROM c0),
chunks AS (SELECT *, lines[1] AS first, array_to_string(lines, ' ') AS joined FROM c1 WHERE len(lines) > 0)"""


def normal(x: str) -> str:
    flat = rf"trim(regexp_replace(lower(regexp_replace(regexp_replace({x}, '[\\\-_]+', ' ', 'g'), '[^A-Za-z0-9 ]+', ' ', 'g')), ' +', ' ', 'g'))"
    return f"array_to_string(list_filter(string_split({flat}, ' '), lambda t: t <> '' AND NOT t IN {_list(C.HEADING_STOP_WORDS)} AND NOT regexp_full_match(t, '[0-9]+|[ivxlcdm]+')), ' ')"


#: At most four words besides stop words and numerals.
_FEW = "(?i)^[^a-z0-9]*(?:DROP(?:[^a-z0-9]+|$))*(?:[a-z0-9]+(?:[^a-z0-9]+|$)(?:DROP(?:[^a-z0-9]+|$))*){0,4}$".replace("DROP", f"(?:{'|'.join((*C.HEADING_STOP_WORDS, '[0-9]+', '[ivxlcdm]+'))})")


def known(x: str) -> str:
    forms = [normal_form(h) for h in C.KNOWN_HEADINGS]
    long = [h for h in C.KNOWN_HEADINGS if len(h) >= 16]
    like = lambda v, hs: f"len(list_filter({'[' + ', '.join(_q(h) for h in hs) + ']'}, lambda h: abs(length({v}) - length(h)) = 1 AND least(length({v}), length(h)) >= 17 AND levenshtein({v}, h) = 1)) > 0"
    raw, nrm = f"lower({strip(x)})", normal(x)
    near = f"CASE WHEN length({raw}) BETWEEN 16 AND 32 THEN {like(raw, long)} ELSE false END"
    # The normal form is worked out once, as the only element of a list.
    by_form = f"len(list_filter([{nrm}], lambda f: f IN {_list(dict.fromkeys(forms))} OR CASE WHEN length(f) BETWEEN 16 AND 32 THEN {like('f', dict.fromkeys([*long, *(f for f in forms if len(f) >= 16)]))} ELSE false END)) > 0"
    return f"({strip(x)} <> '' AND ({raw} IN {_list(C.KNOWN_HEADINGS)} OR {near} OR CASE WHEN regexp_matches({x}, {_q(_FEW)}) THEN {by_form} ELSE false END))"


def short(x: str) -> str:
    h = squeeze(f"string_split({strip(x)}, ':')[1]")
    return f"({x} <> '' AND length({h}) <= {C.MAX_HEADING_CHARS} AND len(list_filter(string_split({h}, ' '), lambda w: w <> '')) <= {C.MAX_HEADING_WORDS})"


def known_prefixed(xs: str) -> str:
    """Whether one of the texts of a list is a known heading, as it stands, before a colon or after a number."""
    number = r"^(?:[0-9]+\.*|[IVXLCMivxlcm]+\.?)\s+"
    forms = f"list_concat(list_concat({xs}, list_transform(list_filter({xs}, lambda x: contains(x, ':')), lambda x: string_split({strip('x')}, ':')[1])), list_transform(list_filter({xs}, lambda x: regexp_matches({strip('x')}, {_q(number)})), lambda x: regexp_replace({strip('x')}, {_q(number)}, '')))"
    return f"(len(list_filter({forms}, lambda y: {known('y')})) > 0)"


def looks_like_heading(x: str) -> str:
    letters, capitals = (f"length(regexp_replace({x}, '[^{c}]', '', 'g'))" for c in (r"\p{L}", r"\p{Lu}"))
    before = f"string_split({x}, ':')[1]"
    short_one = rf"({letters} > 0 AND {capitals} >= {letters} * 0.6) OR regexp_matches({x}, '^([0-9]|[IVXLCM]+\.)') OR (ends_with({x}, ':') AND len(string_split_regex({x}, '\s+')) <= 12) OR {known(x)}"
    return f"({x} <> '' AND (({short(x)} AND ({short_one})) OR (contains({x}, ':') AND {short(before)} AND {known(before)})))"


def kind(lines: str) -> str:
    first, joined = f"({lines})[1]", f"array_to_string({lines}, ' ')"
    listed = rf"len(list_filter({lines}, lambda x: string_split_regex(x, '\s+')[1] IN {_list(C.BULLETS)} OR regexp_matches(string_split_regex(x, '\s+')[1], {_q(C.LIST_TOKEN)}))) > 0"
    table = rf"len(list_filter({lines}, lambda x: contains(x, chr(9)) OR length(x) - length(replace(x, '|', '')) >= 2 OR regexp_matches(x, '\s{{2,}}\S+\s{{2,}}'))) >= greatest(2, len({lines}) // 2)"
    return f"CASE WHEN regexp_matches({first}, {_q(C.CAPTION)}) THEN 'CAPTION' WHEN {known_prefixed(f'[{first}, {joined}]')} THEN 'HEADING' WHEN {listed} THEN 'LIST' WHEN {table} THEN 'TABLE' WHEN {looks_like_heading(joined)} THEN 'HEADING' ELSE 'PARA' END"


def reads_like_text(lines: str) -> str:
    joined = f"array_to_string({lines}, ' ')"
    return rf"NOT {known_prefixed(f'[({lines})[1]]')} AND NOT {looks_like_heading(joined)} AND (len(string_split_regex({joined}, '\s+')) > {C.MAX_HEADING_WORDS} OR length({joined}) >= {C.MIN_SENTENCE_CHARS} OR regexp_matches({joined}, '[.?!]'))"


def layout_heading(x: str) -> str:
    return squeeze(f"regexp_replace({squeeze(x)}, {_q(C.HEADING_NUMBER)}, '')")


def ontology(x: str) -> str:
    t = squeeze(rf"regexp_replace(lower({layout_heading(x)}), '[^\w\s]', '', 'g')")
    cases = "".join(f" WHEN {t} = {_q(s)} OR starts_with({t}, {_q(s + ' ')}) THEN '{n}'" for n, ss in C.ONTOLOGY.items() for s in ss)
    return f"CASE{cases} WHEN {t} IN {_list(k.lower() for k in C.ONTOLOGY)} THEN upper({t}) END"


def canonical(x: str) -> str:
    t = f"trim(regexp_replace(upper(regexp_replace({x}, '[^A-Za-z0-9 ]+', ' ', 'g')), ' +', ' ', 'g'))"
    cases = "".join(" WHEN " + " OR ".join(f"{t} = {_q(a)} OR starts_with({t}, {_q(a + ' ')})" for a in aliases) + f" THEN '{n}'" for n, aliases in C.SECTION_ALIASES.items())
    return f"CASE WHEN {t} = '' THEN 'SECTION'{cases} ELSE {t} END"


# Blocks: a suffix of a chunk's lines is looked at as long as what stands before it are headings alone.
def _blocks(chunks: str, page: str) -> str:
    return rf"""{chunks},
t(doc_id, chunk, i, lines, kind) AS (
  SELECT doc_id, chunk, 0, lines, {kind("lines")} FROM chunks
  UNION ALL SELECT doc_id, chunk, i + 1, lines[2:], {kind("lines[2:]")} FROM t WHERE kind = 'HEADING' AND len(lines) > 1 AND {reads_like_text("lines[2:]")}),
b0 AS (SELECT *, i = max(i) OVER (PARTITION BY doc_id, chunk) AS last FROM t),
b1 AS (SELECT doc_id, {page} AS page, row_number() OVER (PARTITION BY doc_id ORDER BY chunk, i) - 1 AS block_id, CASE WHEN last THEN kind ELSE 'HEADING' END AS kind, CASE WHEN last THEN lines ELSE lines[1:1] END AS lines FROM b0),
blocks AS (SELECT doc_id, block_id, page, kind, CASE kind WHEN 'TABLE' THEN '[[TABLE ' || sum(CAST(kind = 'TABLE' AS BIGINT)) OVER w || ' on page ' || page || ']]' WHEN 'LIST' THEN array_to_string(lines, chr(10)) ELSE array_to_string(lines, ' ') END AS text
  FROM b1 WINDOW w AS (PARTITION BY doc_id ORDER BY block_id ROWS UNBOUNDED PRECEDING)),
a0 AS (SELECT *, bool_and(kind = 'HEADING') OVER (PARTITION BY doc_id) AS bare, sum(CAST(kind = 'HEADING' AS BIGINT)) OVER w AS run, last_value(CASE WHEN kind = 'HEADING' THEN text END IGNORE NULLS) OVER w AS head
  FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_id ROWS UNBOUNDED PRECEDING)),
a1 AS (SELECT *, CASE WHEN bare THEN 0 ELSE dense_rank() OVER (PARTITION BY doc_id ORDER BY run) - 1 END AS section_id FROM a0 WHERE bare OR kind <> 'HEADING'),
a2 AS (SELECT *, max(section_id) OVER (PARTITION BY doc_id) AS last_section, CASE WHEN bare THEN 'Document' ELSE coalesce(head, 'Front Matter') END AS title FROM a1),
assigned AS (SELECT *, CASE WHEN bare THEN 'SECTION' WHEN last_section = 0 OR head IS NULL THEN 'FRONTMATTER' ELSE {canonical("title")} END AS section_name FROM a2)"""


_BLOCKS = _blocks(_CHUNKS, "1")
# Pages at form feeds; a chunk's number is that of its page, six digits, and its own.
_PAGE_START = "CASE WHEN doc_id % 6 = 0 THEN chr(12) || ' ' || chr(10) || chr(12) WHEN doc_id % 3 = 0 THEN chr(12) ELSE chr(10) || chr(10) END"


def page_text(x: str) -> str:
    joined = rf"regexp_replace(replace({x}, chr(13), ''), '([\p{{L}}\p{{N}}_])-\s*\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({joined}, '([\p{{L}}\p{{N}}_])-\s*\n([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[\t\x{{A0}}]+', ' ', 'g')"


_PAGED_CHUNKS = rf"""papers AS (SELECT doc_id // 10 AS doc_id, string_agg({_PAGE_START} || {_PART} || {_NN} || text, '' ORDER BY doc_id) AS text FROM documents GROUP BY doc_id // 10),
pg0 AS (SELECT doc_id, list_filter(string_split_regex(text, '\f+'), lambda p: {strip("p")} <> '') AS r FROM papers),
pg AS (SELECT doc_id, unnest(range(1, len(r) + 1)) AS page, {page_text("unnest(r)")} AS text FROM pg0),
c0 AS (SELECT doc_id, page * 1000000 + unnest(range(0, len(r))) AS chunk, unnest(r) AS raw FROM (SELECT doc_id, page, string_split_regex(text, '\n\s*\n') AS r FROM pg)),
c1 AS (SELECT doc_id, chunk, list_filter(list_transform(string_split(raw, chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS lines FROM c0),
chunks AS (SELECT *, lines[1] AS first, array_to_string(lines, ' ') AS joined FROM c1 WHERE len(lines) > 0)"""
_PAGED = _blocks(_PAGED_CHUNKS, "chunk // 1000000")

# Sentences of narrative blocks, glued, and windows of them in each section.
_PAPER_WINDOWS = f"""{_BLOCKS},
x0 AS (SELECT doc_id, section_id, block_id, kind, unnest(range(0, len(ss))) AS i, unnest(ss) AS s FROM (SELECT *, {sentences("text")} AS ss FROM assigned WHERE kind <> 'TABLE')),
x1 AS (SELECT *, sum(CAST(length(s) >= {C.MIN_SENTENCE_CHARS} AS BIGINT)) OVER (PARTITION BY doc_id, block_id) AS total,
  coalesce(sum(CAST(length(s) >= {C.MIN_SENTENCE_CHARS} AS BIGINT)) OVER (PARTITION BY doc_id, block_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x0),
x2 AS (SELECT doc_id, section_id, block_id, any_value(kind) AS kind, CAST(least(before, greatest(total - 1, 0)) AS BIGINT) AS nth, string_agg(s, ' ' ORDER BY i) AS text FROM x1 GROUP BY doc_id, section_id, block_id, CAST(least(before, greatest(total - 1, 0)) AS BIGINT)),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id, nth) - 1 AS sentence_id FROM x2),
y AS (SELECT doc_id, section_id, list(text ORDER BY sentence_id) AS ss, list(sentence_id ORDER BY sentence_id) AS ids FROM d WHERE kind IN ('PARA', 'CAPTION') GROUP BY doc_id, section_id),
win AS (SELECT doc_id, section_id, k * 2 AS span_start, least(k * 2 + 3, len(ss)) - 1 AS span_end, list_slice(ss, k * 2 + 1, k * 2 + 3) AS ws, list_slice(ids, k * 2 + 1, k * 2 + 3) AS sentence_ids
  FROM (SELECT *, unnest(range(0, CAST(ceil(greatest(len(ss) - 3, 0) / 2.0) AS BIGINT) + 1)) AS k FROM y)),
wt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_id, span_start) - 1 AS window_id, array_to_string(ws, ' ') AS text_raw FROM win)"""

# --- layout

_LAYOUT = rf"""{_PAPERS},
l0 AS (SELECT doc_id, list_filter(string_split_regex(text, '\n\s*\n'), lambda p: {strip("p")} <> '') AS r FROM papers),
l1 AS (SELECT doc_id, unnest(range(0, len(r))) AS seq, unnest(r) AS text FROM l0)"""
_INLINE = r"^\s*([A-Za-z][A-Za-z \-/&]+?)\s*[:–—-]\s+(.*)$"
_CANDIDATES = rf"""{_LAYOUT},
l2 AS (SELECT *, {strip("text")} AS body FROM l1),
l3 AS (SELECT *, {strip("string_split(body, chr(10))[1]")} AS first, {strip(r"regexp_replace(body, '^[^\n]*\n?', '')")} AS rest FROM l2),
l4 AS (SELECT *, {layout_heading("first")} AS norm, {layout_heading(f"regexp_extract(first, {_q(_INLINE)}, 1)")} AS head, regexp_extract(first, {_q(_INLINE)}, 2) AS tail FROM l3),
l5 AS (SELECT *, regexp_matches(first, {_q(_INLINE)}) AND ({ontology("head")}) IS NOT NULL AS is_inline,
  (norm <> '' AND len(string_split(norm, ' ')) <= 7 AND ({ontology("norm")}) IS NOT NULL) OR (length(body) <= 120 AND len(string_split_regex(body, '\s+')) <= 14 AND NOT ends_with(body, '.') AND regexp_matches(body, {_q(C.HEADING_NUMBER)})) AS is_head,
  {strip(r"CASE WHEN rest <> '' THEN tail || chr(10) || rest ELSE tail END")} AS after FROM l4),
l6 AS (SELECT doc_id, seq, unnest(CASE WHEN is_inline THEN [{{'part': 0, 'type': 'HEADING_CAND', 'text': head}}, {{'part': 1, 'type': 'PARA', 'text': after}}]
  WHEN is_head THEN [{{'part': 0, 'type': 'HEADING_CAND', 'text': norm}}, {{'part': 1, 'type': 'PARA', 'text': rest}}]
  WHEN regexp_matches(body, '(?i)^(Figure|Fig\.|Table)\s*\d+[:\.]') THEN [{{'part': 0, 'type': 'CAPTION_CAND', 'text': text}}] ELSE [{{'part': 0, 'type': 'PARA', 'text': text}}] END) AS u FROM l5),
cand AS (SELECT doc_id, seq, CAST(u.part AS BIGINT) AS part, u.type AS type, u.text AS text FROM l6 WHERE NOT (u.text = '' AND u.type <> 'CAPTION_CAND')),
mapped AS (SELECT *, CASE WHEN type = 'HEADING_CAND' THEN {ontology("text")} END AS mapped FROM cand),
lab AS (SELECT *, coalesce(last_value(mapped IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq, part ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS label FROM mapped)"""

# Rows of plain text stand in one column without gaps, so within paragraphs only a bullet behind a bullet begins anew.
_MERGED = rf"""WITH RECURSIVE {_CANDIDATES}, p0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, part) AS k, regexp_matches(text, {_q(C.BULLET_LINE)}) AS bullet FROM lab),
fold(doc_id, k, type, bullet, set, new) AS (
  SELECT doc_id, k, type, bullet, bullet, true FROM p0 WHERE k = 1
  UNION ALL SELECT p0.doc_id, p0.k, p0.type, p0.bullet, p0.bullet AND (p0.type <> 'PARA' OR f.type <> 'PARA' OR f.set), p0.type <> 'PARA' OR f.type <> 'PARA' OR (p0.bullet AND f.set) FROM fold f JOIN p0 ON p0.doc_id = f.doc_id AND p0.k = f.k + 1),
p1 AS (SELECT p0.*, sum(CAST(new AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY k) AS para FROM p0 JOIN fold USING (doc_id, k)),
p2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para ORDER BY k) AS i, lag(text) OVER (PARTITION BY doc_id, para ORDER BY k) AS before, row_number() OVER (PARTITION BY doc_id, para ORDER BY k DESC) AS back FROM p1),
p3 AS (SELECT doc_id, para, any_value(label) AS label, min(seq) AS seq, sum(CASE WHEN i = 1 THEN length(text) ELSE length({strip("text")}) + CASE WHEN ends_with(before, '-') THEN -length(regexp_extract(before, '-+$')) ELSE 1 END END) AS n FROM p2 GROUP BY doc_id, para),
p4 AS (SELECT *, CAST(coalesce(lag(label) OVER (PARTITION BY doc_id ORDER BY para), '') <> label AS BIGINT) AS new FROM p3),
p5 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY para ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS section_id FROM p4)"""

# --- neighbours

_KNN = """
q AS (SELECT vec_id AS query_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
n0 AS (SELECT query_id, q.label, c.vec_id, list_inner_product(e, CAST(c.embedding AS DOUBLE[])) AS sim FROM q JOIN embeddings c ON c.vec_id <> q.query_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM n0) WHERE rank <= 5),
wf AS (SELECT query_id, any_value(label) AS label, max(sim) FILTER (rank = 1) AS max_sim, avg(sim) FILTER (rank <= 3) AS mean_top3, max(vec_id) FILTER (rank = 1) AS nn_id FROM n GROUP BY query_id),
wa AS (SELECT *, CAST(max_sim >= 0.78 AS BIGINT) AS above_tau FROM wf)"""

# --- language model

_LM = f"""
t AS (SELECT doc_id, unnest({lower_words("text")}) AS token FROM documents),
c AS (SELECT token, count(*) AS n FROM t GROUP BY token),
tot AS (SELECT sum(n) AS nn, count(*) AS vv FROM c),
uni AS (SELECT token, n, (n + 1.0) / (nn + 1.0 * (vv + 1)) AS p, ln((n + 1.0) / (nn + 1.0 * (vv + 1))) AS lp, rank() OVER (ORDER BY n DESC) AS rank FROM c, tot)"""

# Bigrams of two thirds of the documents, the empty context and, in g, every context's distribution.
_K = "0.01::DOUBLE"
_BIGRAMS = f"""
b0 AS (SELECT doc_id, unnest(list_transform(range(1, len(ts) + 1), lambda i: struct_pack(position := i, token := ts[i], context := CASE WHEN i = 1 THEN chr(2) ELSE ts[i - 1] END))) AS e
  FROM (SELECT doc_id, {lower_words("text")} AS ts FROM documents)),
tk AS (SELECT doc_id, e.position AS position, e.token AS token, e.context AS context FROM b0),
c2 AS (SELECT context, token, count(*) AS n FROM tk WHERE doc_id % 3 <> 1 GROUP BY ALL),
cc AS (SELECT * FROM c2 UNION ALL SELECT '' AS context, token, sum(n) AS n FROM c2 GROUP BY token),
vv AS (SELECT count(*) AS v FROM cc WHERE context = ''),
g AS (SELECT context, sum(n) AS n, count(*) AS types, sum(n) + {_K} * (any_value(v) + 1) AS z, sum((n + {_K}) * ln(n + {_K})) AS a, any_value(v) AS v FROM cc, vv GROUP BY context),
gc AS (SELECT context, n, types, z, ln(z) - (a + (v + 1 - types) * {_K} * ln({_K})) / z AS entropy, ln({_K} / z) AS lp, types + 1 AS rank FROM g),
ev AS (SELECT cc.context, token, ln((cc.n + {_K}) / z) AS lp, entropy, rank() OVER (PARTITION BY cc.context ORDER BY cc.n DESC) AS rank FROM cc JOIN gc USING (context)),
sc AS (SELECT tk.doc_id, coalesce(e.lp, gc.lp, u.lp, z.lp) AS lp, coalesce(e.entropy, gc.entropy, u.entropy, z.entropy) AS entropy, coalesce(e.rank, gc.rank, u.rank, z.rank) AS rank
  FROM tk LEFT JOIN ev e ON tk.context = e.context AND tk.token = e.token LEFT JOIN gc ON tk.context = gc.context LEFT JOIN ev u ON u.context = '' AND u.token = tk.token JOIN gc z ON z.context = '')"""

# --- short pieces

_GLUE = f"""
g0 AS (SELECT doc_id, unnest(range(0, len(ss))) AS i, unnest(ss) AS s FROM (SELECT doc_id, {sentences("text")} AS ss FROM documents)),
g1 AS (SELECT *, sum(CAST(length(s) >= 15 AS BIGINT)) OVER (PARTITION BY doc_id) AS total, coalesce(sum(CAST(length(s) >= 15 AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g0),
g2 AS (SELECT doc_id, CAST(least(before, greatest(total - 1, 0)) AS BIGINT) AS sentence_id, string_agg(s, ' ' ORDER BY i) AS sentence FROM g1 GROUP BY ALL)"""

# Two variants of each document: words and numbers dropped, then neighbours swapped, by draws of md5.
_DRAW = lambda i, what: f"(CAST('0x' || substr(md5(doc_id || ':' || k || ':' || {i} || ':{what}'), 1, 8) AS BIGINT) % 10000) / 10000.0"
_WORDY = lambda x: rf"regexp_full_match({x}, '[\p{{L}}\p{{N}}]+')"
_VARIANTS = rf"""
v0 AS (SELECT doc_id, k, regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s]') AS toks FROM documents, (SELECT unnest([1, 2]) AS k)),
v1 AS (SELECT doc_id, k, unnest(range(0, len(toks))) AS i, unnest(toks) AS t FROM v0),
v2 AS (SELECT doc_id, k, t, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) - 1 AS i FROM v1 WHERE NOT {_WORDY("t")} OR {_DRAW("i", "drop")} >= 0.05),
v3 AS (SELECT *, lead(t) OVER w AS t2, lag(t) OVER w AS t0, i % 2 = 0 AND {_DRAW("i", "swap")} < 0.1 AND {_WORDY("t")} AND {_WORDY("coalesce(lead(t) OVER w, '')")} AS hit FROM v2 WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
v4 AS (SELECT doc_id, k, i, CASE WHEN hit THEN t2 WHEN i % 2 = 1 AND lag(hit) OVER (PARTITION BY doc_id, k ORDER BY i) THEN t0 ELSE t END AS t FROM v3),
v5 AS (SELECT doc_id, k, string_agg(t, ' ' ORDER BY i) AS text FROM v4 GROUP BY doc_id, k),
variants AS (SELECT documents.doc_id, z.k, coalesce(v5.text, '') AS text FROM documents CROSS JOIN (SELECT unnest([1, 2]) AS k) z LEFT JOIN v5 ON v5.doc_id = documents.doc_id AND v5.k = z.k)"""


def _letters(x: str) -> str:
    counts = f"list_transform(range(97, 123), lambda c: CAST(length(lower({x})) - length(replace(lower({x}), chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"
    return f"list_transform([{counts}], lambda v: list_transform(v, lambda a: CASE WHEN list_inner_product(v, v) = 0 THEN a ELSE a / sqrt(list_inner_product(v, v)) END))[1]"


# Windows and the benchmark's passages by letter counts; the five nearest of each window.
_NEAR = f"""
pv AS (SELECT item_id AS vec_id, text, {_letters("text")} AS e FROM benchmark),
wv AS (SELECT doc_id, window_id, text_raw, {_letters("text_raw")} AS e FROM wt),
n0 AS (SELECT doc_id, window_id, vec_id, list_inner_product(wv.e, pv.e) AS sim FROM wv, pv),
n1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, window_id ORDER BY sim DESC, vec_id) AS rank FROM n0),
nn AS (SELECT doc_id, window_id, max(sim) FILTER (rank = 1) AS max_sim, avg(sim) FILTER (rank <= 3) AS mean_top3, max(vec_id) FILTER (rank = 1) AS nn_id, CAST(max(sim) FILTER (rank = 1) >= 0.78 AS BIGINT) AS above_tau FROM n1 WHERE rank <= 5 GROUP BY ALL)"""

_META = META_WEIGHTS
_RAW_FEATURES = ["avg(n_words)", "avg(avg_word_len)", "avg(ttr)", "avg(burst_cv)", "max(flesch)", "CAST(count(*) AS DOUBLE)"]
_Z = [f"((f[{k + 1}] - {m}) / {s or 1.0})" for k, (m, s) in enumerate(zip(_META["mu"], _META["sigma"], strict=True))]
_DOTS = [" + ".join(f"{z} * {w}" for z, w in zip(_Z, ws, strict=True)) + f" + {b}" for ws, b in zip(_META["weights"], _META["bias"], strict=True)]



def _layers(source: str, keep: str, f: str) -> str:
    """SQL of the two layers over the list f of a source's features."""
    z = [f"(({f})[{k + 1}] - {m}) / {s or 1.0}" for k, (m, s) in enumerate(zip(_META["mu"], _META["sigma"], strict=True))]
    one, two = META_LAYERS["layers"]
    dense = lambda xs, layer: [" + ".join(f"{x} * ({w})" for x, w in zip(xs, ws, strict=True)) + f" + ({b})" for ws, b in zip(layer["weights"], layer["bias"], strict=True)]
    hidden = ", ".join(f"greatest(0.0, {x}) AS h{k}" for k, x in enumerate(dense(z, one)))
    last = ", ".join(f"{x} AS o{k}" for k, x in enumerate(dense([f"h{k}" for k in range(4)], two)))
    ps = ", ".join(f"round(exp(o{k}) / (exp(o0) + exp(o1) + exp(o2)), 6) AS {p}" for k, p in enumerate(_P))
    return f"SELECT {keep}, {ps} FROM (SELECT {keep}, {last} FROM (SELECT {keep}, {hidden} FROM {source}))"


# The whole analysis by style alone, of papers.
_ANALYSIS = f"""WITH RECURSIVE {_PAPER_WINDOWS}, {_style("wt", "doc_id, window_id, sentence_ids", sentences("text_raw"))}, {_SCORE},
sm AS (SELECT doc_id, window_id, sentence_ids, {", ".join(f"avg({p}) OVER w AS {p}" for p in _P)} FROM pr WINDOW w AS (PARTITION BY doc_id ORDER BY window_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
lw AS (SELECT *, {_LABEL} AS window_label, greatest(p_human, p_ai, p_paraphrased_ai) AS window_confidence FROM sm),
x AS (SELECT doc_id, unnest(sentence_ids) AS sentence_id, p_human, p_ai, p_paraphrased_ai FROM lw),
m AS (SELECT doc_id, sentence_id, {", ".join(f"avg({p}) AS {p}" for p in _P)} FROM x GROUP BY ALL),
sp AS (SELECT d.doc_id, coalesce(p_human, 1.0) AS p_human, coalesce(p_ai, 0.0) AS p_ai, coalesce(p_paraphrased_ai, 0.0) AS p_paraphrased_ai FROM d LEFT JOIN m USING (doc_id, sentence_id)),
js AS (SELECT doc_id, {_LABEL} AS label FROM sp), a AS ({_SUMMARY}), pct AS (SELECT doc_id, """ + ", ".join(f"avg(CASE WHEN label = '{x}' THEN 100.0 ELSE 0.0 END) AS pct_{x}" for x in C.LABELS) + """ FROM js GROUP BY doc_id)"""

ORACLES = {
    "stylometry_documents": f"{_DOC_STYLE} SELECT doc_id, n_sent, n_words, {_r('avg_word_len', 'ttr')}, round({_MATTR}, 6) AS mattr, {_r(*_POS, 'burst_b', 'burst_cv', 'mean_slen', 'flesch', 'fk_grade', 'gunning_fog')} FROM style WHERE n_sent > 0",
    "sentence_split": f"SELECT doc_id, unnest(range(0, len(ss))) AS sentence_id, unnest(ss) AS sentence FROM (SELECT doc_id, {sentences('text')} AS ss FROM documents)",
    "token_counts": f"SELECT doc_id, len({words('text')}) AS n_tokens, CAST({syllables('text')} AS BIGINT) AS n_syllables, len(list_filter({words('text')}, lambda w: {vowels('w')} >= 3)) AS n_complex, len(list_distinct({lower_words('text')})) AS n_types FROM documents",
    "lexical_diversity": f"WITH x AS (SELECT doc_id, {lower_words('text')} AS toks FROM documents), y AS (SELECT *, len(toks) AS n_words FROM x) SELECT doc_id, round({_TTR}, 6) AS ttr, round({_MATTR}, 6) AS mattr FROM y",
    "pos_ratios": f"{_DOC_STYLE} SELECT doc_id, {_r(*_POS)} FROM style WHERE n_sent > 0",
    "burstiness": f"{_DOC_STYLE} SELECT doc_id, {_r('burst_b', 'burst_cv', 'mean_slen')} FROM style WHERE n_sent > 0",
    "readability": f"{_DOC_STYLE} SELECT doc_id, {_r('flesch', 'fk_grade', 'gunning_fog')} FROM style WHERE n_sent > 0",
    "sentence_windows": f"WITH {_WINDOWS} SELECT doc_id, window_id, span_start, span_end, text_raw FROM wt",
    "glue_short_sentences": f"WITH {_GLUE} SELECT * FROM g2",
    "page_normalize": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '. ', '-' || chr(13) || chr(10)) || chr(9) || repeat(chr(10), 4) || '.', chr(13), ''), '([\p{L}\p{N}_])-\s*\n([\p{L}\p{N}_])', '\1\2', 'g'), '([\p{L}\p{N}_])-\s*\n([\p{L}\p{N}_])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[\t\x{A0}]+', ' ', 'g') AS text FROM documents""",
    "strip_math": f"SELECT doc_id, {squeeze(f'regexp_replace(text, {_q(C.MATH)}, {_q(" ")}, {_q("g")})')} AS clean_text FROM documents",
    "layout_text_scan": f"WITH {_LAYOUT} SELECT doc_id, seq, CAST(0 AS BIGINT) AS page, seq * 100.0::DOUBLE AS top, (seq + 1) * 100.0::DOUBLE AS bottom, length(text) AS n_chars FROM l1",
    "block_classify": f"WITH {_CHUNKS} SELECT doc_id, chunk, {kind('lines')} AS block_type, len(lines) AS n_lines FROM chunks",
    "section_build": f"WITH RECURSIVE {_BLOCKS} SELECT doc_id, section_id, any_value(title) AS title, any_value(section_name) AS section_name, any_value(section_name) IN {_list(C.REFERENCE_SECTIONS)} AS is_references, section_id = 0 AS is_frontmatter, list(block_id ORDER BY block_id) AS block_ids FROM assigned GROUP BY doc_id, section_id",
    "page_block_index": f"WITH RECURSIVE {_BLOCKS} SELECT doc_id, CAST(1 AS BIGINT) AS page, list(block_id ORDER BY block_id) AS block_ids FROM blocks GROUP BY doc_id",
    "paged_blocks": f"WITH RECURSIVE {_PAGED} SELECT doc_id, block_id, page, kind AS block_type, md5(text) AS text_md5, CASE WHEN kind = 'TABLE' THEN text END AS placeholder FROM blocks",
    "paged_index": f"WITH RECURSIVE {_PAGED} SELECT doc_id, page, list(block_id ORDER BY block_id) AS block_ids FROM blocks WHERE page <= 3 GROUP BY doc_id, page",
    "paged_sections": f"WITH RECURSIVE {_PAGED} SELECT doc_id, section_id, any_value(title) AS title, any_value(section_name) AS section_name, min(page) AS first_page, max(page) AS last_page, count(*) AS n_blocks FROM assigned GROUP BY doc_id, section_id",
    "full_pipeline": f"{_ANALYSIS} SELECT doc_id, coalesce(num_windows, 0) AS num_windows, {', '.join(f'round(coalesce({c}, {v}), 6) AS {c}' for c, v in (('coverage_ai', 0.0), ('coverage_paraphrased', 0.0), ('p_human', 1.0), ('p_ai', 0.0), ('p_paraphrased_ai', 0.0), ('pct_human', 100.0), ('pct_ai', 0.0), ('pct_paraphrased_ai', 0.0)))}, CAST(0 AS DOUBLE) AS max_sim, CAST(0 AS DOUBLE) AS detectgpt_mean, coalesce({_verdict('p_ai', 'p_paraphrased_ai')}, 'human') AS verdict FROM papers LEFT JOIN a USING (doc_id) LEFT JOIN pct USING (doc_id)",
    "layout_tables": f"""WITH d AS (SELECT doc_id, {sentences("text")} AS ss FROM documents),
x AS (SELECT doc_id, unnest(range(0, len(ss))) AS i, unnest(ss) AS s FROM d), cells AS (SELECT doc_id, i // 3 AS row, i % 3 AS c, {squeeze("s")} AS cell FROM x),
grid AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(ss) / 3.0) AS BIGINT))) AS row FROM d), h(c, header) AS (VALUES (0, 'TITLE_AUTHOR_YEAR'), (1, 'METHODOLOGY'), (2, 'KEY_FINDINGS'))
SELECT doc_id, row, header, coalesce(cell, '') AS cell FROM grid CROSS JOIN h LEFT JOIN cells USING (doc_id, row, c)""",
    "heading_match": f"WITH {_CHUNKS}, x AS (SELECT doc_id, chunk, unnest(range(0, len(lines))) AS nth, unnest(lines) AS line FROM chunks) SELECT doc_id, chunk, nth, {known('line')} AS known, {short('line')} AS short, {normal('line')} AS normal FROM x",
    "section_canonical": f"WITH {_CHUNKS} SELECT doc_id, chunk, {canonical('first')} AS section_name, {ontology('first')} AS label FROM chunks",
    "knn_topk": f"WITH {_KNN} SELECT query_id, rank, vec_id, round(sim, 6) AS sim FROM n",
    "knn_all_rows": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS sim FROM v q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 3""",
    "paraphrase_window_features": f"WITH {_KNN} SELECT query_id, {_r('max_sim', 'mean_top3')}, above_tau, nn_id FROM wa",
    "paraphrase_doc_features": f"WITH {_KNN} SELECT CAST(label AS BIGINT) AS doc_id, round(avg(above_tau), 6) AS coverage, round(max(max_sim), 6) AS max_sim, round(avg(mean_top3), 6) AS top3_mean, round(avg(above_tau), 6) AS frac_above_tau, count(*) AS num_windows FROM wa GROUP BY label",
    "lm_unigram_scores": f"WITH {_LM} SELECT token, n, {_r('p', 'lp')}, rank FROM uni",
    "lm_token_aggregates": f"WITH {_LM}, h AS (SELECT -sum(p * lp) AS entropy FROM uni) SELECT doc_id, round(avg(lp), 6) AS logprob, round(exp(avg(-lp)), 6) AS ppl, round(any_value(entropy), 6) AS mean_entropy, round(avg(-lp), 6) AS surprisal_mean, round(var_pop(-lp), 6) AS surprisal_var, round(avg(rank), 6) AS avg_rank FROM t JOIN uni USING (token), h GROUP BY doc_id",
    "lm_top_entropy": f"WITH {_LM}, top AS (SELECT p FROM uni ORDER BY p DESC, token LIMIT 100), s AS (SELECT sum(p) AS s FROM top) SELECT round(-sum(p / s * ln(p / s)), 6) AS entropy FROM top, s",
    "lm_bigram_contexts": f"WITH {_BIGRAMS} SELECT context, n, types, {_r('entropy', 'lp')}, rank FROM gc",
    "lm_bigram_scores": f"WITH {_BIGRAMS} SELECT doc_id, round(avg(lp), 6) AS logprob, round(log10(exp(avg(-lp))), 6) AS ppl, round(avg(entropy), 6) AS mean_entropy, round(avg(-lp), 6) AS surprisal_mean, round(var_pop(-lp), 6) AS surprisal_var, round(avg(rank), 6) AS avg_rank FROM sc GROUP BY doc_id",
    "perturbed_texts": f"WITH {_VARIANTS} SELECT doc_id, k, md5(text) AS text_md5 FROM variants",
    "perturbation_score_md5": f"""WITH {_LM}, {_VARIANTS}, base AS (SELECT doc_id, avg(lp) AS m FROM t JOIN uni USING (token) GROUP BY doc_id),
vt AS (SELECT doc_id, k, unnest({lower_words("text")}) AS token FROM variants), vm AS (SELECT doc_id, k, avg(lp) AS m FROM vt JOIN uni USING (token) GROUP BY doc_id, k), va AS (SELECT doc_id, avg(m) AS m FROM vm GROUP BY doc_id)
SELECT doc_id, round(coalesce(base.m - va.m, 0.0), 6) AS detectgpt_score FROM documents LEFT JOIN base USING (doc_id) LEFT JOIN va USING (doc_id)""",
    "window_branches": f"""WITH {_LM}, {_WINDOWS}, {_style("wt", "doc_id, window_id", sentences("text_raw"))}, {_NEAR}, h AS (SELECT -sum(p * lp) AS entropy FROM uni),
wk AS (SELECT doc_id, window_id, unnest({lower_words("text_raw")}) AS token FROM wt), wl AS (SELECT doc_id, window_id, avg(lp) AS logprob, var_pop(lp) AS surprisal_var, avg(rank) AS avg_rank FROM wk JOIN uni USING (token) GROUP BY ALL)
SELECT doc_id, window_id, n_words, {_r("ttr", "flesch")}, round(coalesce(logprob, 0.0), 6) AS logprob, round(CASE WHEN logprob IS NULL THEN -9.0 ELSE -logprob / ln(10) END, 6) AS ppl, round(CASE WHEN logprob IS NULL THEN 0.0 ELSE entropy END, 6) AS mean_entropy,
  round(coalesce(surprisal_var, 0.0), 6) AS surprisal_var, round(coalesce(avg_rank, 0.0), 6) AS avg_rank, CAST(0 AS DOUBLE) AS detectgpt_score, {_r("max_sim", "mean_top3")}, above_tau, nn_id FROM style LEFT JOIN wl USING (doc_id, window_id) JOIN nn USING (doc_id, window_id), h""",
    "paraphrase_search": f"""WITH {_WINDOWS}, {_NEAR}, a AS (SELECT doc_id, avg(above_tau) AS coverage, max(max_sim) AS max_sim, avg(mean_top3) AS top3_mean, count(*) AS num_windows FROM nn GROUP BY doc_id),
b AS (SELECT doc_id, left(text, 20) AS begins FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY max_sim DESC, window_id) AS r FROM nn) JOIN pv ON nn_id = vec_id WHERE r = 1)
SELECT doc_id, round(coverage, 6) AS coverage, round(max_sim, 6) AS max_sim, round(top3_mean, 6) AS top3_mean, round(coverage, 6) AS frac_above_tau, num_windows, begins FROM a JOIN b USING (doc_id)""",
    "styled_page_text": rf"""WITH s AS (SELECT doc_id, unnest(range(0, len(ss))) AS seq, unnest(ss) AS text FROM (SELECT doc_id, {sentences("text")} AS ss FROM documents)),
l0 AS (SELECT doc_id, seq // 40 + 1 AS page, seq, text, CASE WHEN seq % 7 = 0 THEN 13.0 WHEN seq % 3 = 0 THEN 10.7 ELSE 10.0 END::DOUBLE AS size, seq % 2 = 0 AS bold, len(string_split_regex(text, '\s+')) AS n FROM s),
l1 AS (SELECT *, coalesce(median(CASE WHEN n >= 2 THEN size END) OVER (PARTITION BY doc_id, page), 10.0) AS base FROM l0),
l2 AS (SELECT *, length(text) <= {C.MAX_HEADING_CHARS} AND n <= {C.MAX_HEADING_WORDS} AND NOT ends_with(text, '.') AND (size >= base * 1.18 OR (bold AND size >= base * 1.06) OR regexp_matches(text, '^([0-9]+(\.[0-9]+)*|[IVXLCM]+[.])\s+') OR {known("text")}) AS head FROM l1),
l3 AS (SELECT *, head OR coalesce(lag(head) OVER w, true) AS new FROM l2 WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq)),
l4 AS (SELECT *, sum(CAST(new AS BIGINT)) OVER (PARTITION BY doc_id, page ORDER BY seq) AS run FROM l3),
l5 AS (SELECT doc_id, page, run, string_agg(text, ' ' ORDER BY seq) AS text FROM l4 GROUP BY ALL),
l6 AS (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY run) AS text FROM l5 GROUP BY ALL)
SELECT doc_id, page, md5(text) AS text_md5, length(text) AS n_chars FROM l6""",
    "char_lines": rf"""WITH c0 AS (SELECT doc_id, unnest(range(0, len(cs))) AS k, unnest(cs) AS ch FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS cs FROM documents)),
c AS (SELECT *, k // 80 AS line, (k // 80 % 50) * 12 + CASE WHEN k % 2 = 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS top FROM c0),
g AS (SELECT doc_id, line // 50 AS page, line, string_agg(ch, '' ORDER BY k) AS text, min(k % 80) * 6.0::DOUBLE AS x0, max(k % 80) * 6.0::DOUBLE + 5 AS x1, min(top) AS top, max(top) + 10 AS bottom, avg(9.0::DOUBLE + k % 3) AS font_size FROM c GROUP BY ALL),
h AS (SELECT * FROM g WHERE {strip("text")} <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, line) - 1 AS seq, md5(text) AS text, page, x0, x1, round(top, 6) AS top, round(bottom, 6) AS bottom, round(font_size, 6) AS font_size, line % 5 = 0 AS bold, line % 5 <> 0 AND line % 7 = 0 AS ital FROM h""",
    "boxed_sentences": f"""WITH s AS (SELECT doc_id, unnest(range(0, len(ss))) AS sentence_id FROM (SELECT doc_id, {sentences("text")} AS ss FROM documents))
SELECT doc_id, sentence_id, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS DOUBLE) END AS bbox_x0, CASE WHEN doc_id % 5 <> 0 AND doc_id % 4 <> 0 THEN doc_id + 0.5::DOUBLE END AS bbox_y0, CASE WHEN doc_id % 5 <> 0 THEN 1000.0::DOUBLE END AS bbox_x1,
  CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN 7.0::DOUBLE END AS bbox_y1, CAST(NULL AS VARCHAR) AS placeholder, CASE WHEN doc_id % 5 <> 0 THEN 'parser' END AS block_source FROM s""",
    "classifier_labels": """WITH p AS (SELECT doc_id, ['human', 'ai', 'ai', 'paraphrased_ai', 'other'][doc_id % 5 + 1] AS label, quality * 0.5::DOUBLE + 0.1::DOUBLE AS a, toxic * 1.5::DOUBLE AS b FROM labels)
SELECT doc_id, label, round(a / (a + b), 6) AS p_human, round(b / (a + b), 6) AS p_ai, 0.0::DOUBLE AS p_paraphrased_ai FROM p""",
    "smooth_probs": f"{_SMOOTH} SELECT doc_id, window_id, {_r(*(f'{p}_raw' for p in _P), *_P)} FROM sm",
    "window_labels": f"{_LABELLED} SELECT doc_id, window_id, window_label, round(window_confidence, 6) AS window_confidence FROM lw",
    "sentence_probs": f"{_SENTENCES} SELECT doc_id, sentence_id, {_r(*_P)}, label, round(confidence, 6) AS confidence FROM js",
    "section_summary": f"""{_SENTENCES}, a AS ({_SUMMARY}), n AS (SELECT doc_id, count(*) AS num_sentences FROM js GROUP BY doc_id),
top AS (SELECT doc_id, window_label AS top_label, span_start AS top_start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY window_confidence DESC, window_id) AS r FROM lw) WHERE r = 1)
SELECT doc_id, CAST(0 AS BIGINT) AS section_id, num_windows, num_sentences, {_r('coverage_ai', 'coverage_paraphrased', *_P)}, top_label, top_start FROM a JOIN n USING (doc_id) JOIN top USING (doc_id)""",
    "document_verdict": f"{_LABELLED}, a AS ({_SUMMARY}) SELECT doc_id, num_windows, {_r('coverage_ai', 'coverage_paraphrased')}, CAST(max_sim AS DOUBLE) AS max_sim, CAST(detectgpt_mean AS DOUBLE) AS detectgpt_mean, {_r(*_P)}, {_verdict('p_ai', 'p_paraphrased_ai')} AS verdict FROM a",
    "label_percentages": f"{_SENTENCES} SELECT doc_id, " + ", ".join(f"round(avg(CASE WHEN label = '{x}' THEN 100.0 ELSE 0.0 END), 6) AS pct_{x}" for x in C.LABELS) + " FROM js GROUP BY doc_id",
    "meta_features": f"{_PROBS} SELECT doc_id, list_transform([{', '.join(_RAW_FEATURES)}], lambda x: round(x, 6)) AS features FROM pr GROUP BY doc_id",
    "zscore_softmax": f"{_PROBS}, v AS (SELECT doc_id, [{', '.join(_RAW_FEATURES)}] AS f FROM pr GROUP BY doc_id), z AS (SELECT doc_id, {_DOTS[0]} AS za, {_DOTS[1]} AS zb, {_DOTS[2]} AS zc FROM v) SELECT doc_id, " + ", ".join(f"round(exp({z}) / (exp(za) + exp(zb) + exp(zc)), 6) AS {p}" for z, p in zip(("za", "zb", "zc"), _P, strict=True)) + " FROM z",
    "meta_layers": f"{_PROBS}, v AS (SELECT doc_id, [{', '.join(_RAW_FEATURES)}] AS f FROM pr GROUP BY doc_id) {_layers('v', 'doc_id', 'f')}",
    "meta_window_layers": f"{_PROBS}, v AS (SELECT doc_id, window_id, [n_words, avg_word_len, ttr, 0.0, 0.0, CAST(count(*) OVER (PARTITION BY doc_id) AS DOUBLE)] AS f FROM pr) {_layers('v', 'doc_id, window_id', 'f')}",
    "label_inherit": f"WITH {_CANDIDATES} SELECT doc_id, seq, part, type, label FROM lab",
    "layout_paragraphs": f"{_MERGED} SELECT doc_id, section_id, label, count(*) AS n_units, CAST(0 AS BIGINT) AS n_tables, CAST(sum(n) + 2 * (count(*) - 1) AS BIGINT) AS n_chars FROM p5 GROUP BY doc_id, section_id, label",
    "layout_blocks": f"""{_MERGED}, x AS (SELECT *, array_to_string(list_transform(string_split(lower(replace(label, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM p5)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para) - 1 AS block_id, CAST(1 AS BIGINT) AS page, 'PARA' AS block_type, CAST(n AS BIGINT) AS n_chars, section_id, title, {canonical("title")} AS section_name, 'parser' AS source, 'PARA' AS unit_type, seq * 100.0::DOUBLE AS top FROM x""",
    "section_runs": f"""WITH {_CANDIDATES}, r0 AS (SELECT *, CAST(coalesce(lag(label) OVER (PARTITION BY doc_id ORDER BY seq, part), '') <> label AS BIGINT) AS new FROM lab),
r1 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY seq, part ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS section_id FROM r0)
SELECT doc_id, section_id, label, count(*) AS n_units, md5(string_agg(text, chr(10) || chr(10) ORDER BY seq, part)) AS text_md5 FROM r1 GROUP BY doc_id, section_id, label""",
    "heading_confidence": f"""WITH {_CANDIDATES}, h AS (SELECT *, lag(mapped) OVER (PARTITION BY doc_id ORDER BY seq, part) AS before FROM lab WHERE mapped IS NOT NULL),
b AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before = 'RESULTS' AND mapped IN ('METHODS', 'INTRODUCTION')) AS back FROM h GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS paras FROM lab GROUP BY doc_id),
r AS (SELECT doc_id, greatest(0.0, least(1.0, coalesce(least(1.0, n / greatest(1.0, paras / 6.0)) - 0.1 * back, 0.0))) AS confidence FROM a LEFT JOIN b USING (doc_id))
SELECT doc_id, round(confidence, 6)::DOUBLE AS confidence, CAST(1 AS BIGINT) AS pages, CASE WHEN confidence >= 0.4 THEN 'L3' ELSE 'L0' END AS mode FROM r""",
    "keyword_normalize": r"""WITH k AS (SELECT doc_id, list_filter(list_transform(string_split_regex(trim(regexp_replace(regexp_replace('Keywords: ' || text, '(?i)^\s*keywords?\s*[:\-–—]?\s*', ''), '\s+', ' ', 'g')), '[;,]'), lambda x: regexp_replace(x, '^[ .;:]+|[ .;:]+$', '', 'g')), lambda x: x <> '') AS ks FROM documents) SELECT doc_id, unnest(range(0, len(ks))) AS nth, unnest(ks) AS keyword FROM k""",
    "highlight_html": f"""{_SENTENCES}, h AS (SELECT doc_id, sentence_id, CASE WHEN sentence_id % 10 = 0 THEN '<h3>Section ' || (sentence_id // 10 + 1) || '</h3>' ELSE '' END AS head,
'<span style="background:' || CASE label WHEN 'human' THEN '{C.LABEL_COLOURS["human"]}' WHEN 'ai' THEN '{C.LABEL_COLOURS["ai"]}' ELSE '{C.LABEL_COLOURS["paraphrased_ai"]}' END || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span> ' AS span FROM js)
SELECT doc_id, string_agg(head || CASE WHEN sentence_id % 7 = 3 THEN '<div>• ' || span || '</div>' ELSE span END, '' ORDER BY sentence_id) AS html FROM h GROUP BY doc_id""",
    "annotation_boxes": f"""WITH d AS (SELECT doc_id, {squeeze("text")} AS text FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(ws))) AS k, unnest(ws) AS word FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM d WHERE text <> '')),
pw AS (SELECT *, k // 100 + 1 AS page, lower(word) || ' ' AS part, CAST(k % 10 AS DOUBLE) AS c, CAST(k % 100 // 10 AS DOUBLE) AS line FROM w),
pa AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id, page ORDER BY k) - length(part) AS at FROM (SELECT *, CASE WHEN ends_with(lower(word), '-') AND length(word) > 1 AND k % 10 = 9 AND k % 100 <> 99 AND k < max(k) OVER (PARTITION BY doc_id) THEN left(lower(word), length(word) - 1) ELSE part END AS part FROM (SELECT * EXCLUDE (part), lower(word) || ' ' AS part FROM pw))),
pg AS (SELECT doc_id, page, string_agg(part, '' ORDER BY k) AS shown FROM pa GROUP BY doc_id, page),
s0 AS (SELECT doc_id, unnest(range(0, len(ss))) AS sentence_id, unnest(ss) AS text FROM (SELECT doc_id, {sentences("text")} AS ss FROM d)),
s1 AS (SELECT *, string_split(text, ' ') AS ws FROM s0),
s2 AS (SELECT *, coalesce(sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 100 + 1 AS page FROM s1),
s3 AS (SELECT *, list_transform(list_concat([text, replace(text, '- ', '-'), replace(text, ' -', '-')], list_transform(list_reverse(range(CASE WHEN len(ws) > 3 THEN 3 ELSE len(ws) END, least(len(ws), 8) + 1)), lambda n: array_to_string(ws[1:n], ' '))), lambda x: lower(x)) AS snips FROM s2),
f AS (SELECT s3.doc_id, sentence_id, s3.page, shown, list_filter(snips, lambda x: contains(shown, x))[1] AS snippet FROM s3 JOIN pg ON s3.doc_id = pg.doc_id AND s3.page = pg.page),
h0 AS (SELECT *, list_transform(string_split(shown, snippet), lambda p: length(p)) AS gaps FROM f WHERE snippet IS NOT NULL),
h AS (SELECT * EXCLUDE (nth), list_sum(gaps[1 : nth]) + (nth - 1) * length(snippet) AS place, nth FROM (SELECT *, unnest(range(1, len(gaps))) AS nth FROM h0) WHERE nth <= 64),
b AS (SELECT h.doc_id, h.sentence_id, h.page, nth, line, min(c) * 60 AS x0, max(c) * 60 + 50 AS x1 FROM h JOIN pa ON pa.doc_id = h.doc_id AND pa.page = h.page AND pa.at + length(pa.part) > place AND pa.at < place + length(snippet) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY nth DESC, line DESC) AS back FROM b)
SELECT doc_id, sentence_id, CAST(page AS BIGINT) AS page, 'snippet' AS how, any_value(snippet) AS snippet, any_value(n_hits) AS n_hits, count(*) AS n_boxes, min(x0) FILTER (nth = 1) AS x0, min(line) FILTER (nth = 1) * 12 AS top, max(x1) FILTER (nth = 1) AS x1, max(line) FILTER (nth = 1) * 12 + 10 AS bottom,
  max(x1) FILTER (back = 1) AS last_x1, max(line) FILTER (back = 1) * 12 + 10 AS last_bottom FROM o JOIN (SELECT doc_id, sentence_id, snippet, least(len(gaps) - 1, 64) AS n_hits FROM h0) USING (doc_id, sentence_id) GROUP BY doc_id, sentence_id, page""",
    "pie_stops": f"""{_SENTENCES}, l(pos, label) AS (VALUES (0, 'human'), (1, 'ai'), (2, 'paraphrased_ai')), n AS (SELECT doc_id, count(*) AS total, count(*) FILTER (label = 'human') AS a, count(*) FILTER (label = 'ai') AS b, count(*) FILTER (label = 'paraphrased_ai') AS c FROM js GROUP BY doc_id),
s AS (SELECT doc_id, pos, label, [a, b, c][pos + 1] / total * 100 AS share FROM n, l), ends AS (SELECT *, sum(share) OVER (PARTITION BY doc_id ORDER BY pos) AS "end" FROM s)
SELECT doc_id, label, round(share, 6) AS share, round("end" - share, 6) AS "begin", round("end", 6) AS "end" FROM ends""",
}
