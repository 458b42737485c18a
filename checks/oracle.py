"""The queries as plain SQL for DuckDB, written independently of the library."""

from __future__ import annotations

SPACES = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, '{SPACES}')"


def swap(x: str, words: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.items())
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"


WORDS = {
    "the": "le", "and": "et", "of": "de", "in": "dans", "le": "der", "la": "die", "les": "den",
    "de": "von", "et": "und", "der": "el", "die": "ella", "und": "y", "el": "the", "y": "and",
}
BACK = {"le": "the", "et": "and", "de": "of", "der": "le", "die": "la", "von": "de", "und": "et"}
PART_WORDS = {"small": "klein", "red": "rot", "blue": "blau", "ECONOMY": "SPAR", "bolt": "Bolzen"}

EVERY = f"""
every AS (
  SELECT doc_id, lang, unnest(range(len(l)))::INTEGER AS "index", unnest(l) AS text
  FROM (SELECT doc_id, lang, string_split(text, {NL}) AS l FROM documents))"""
PARAS = f"""{EVERY},
paras AS (
  SELECT doc_id, lang, "index", text,
         (row_number() OVER (PARTITION BY doc_id ORDER BY "index") - 1)::INTEGER AS pos
  FROM every WHERE {strip('text')} <> '')"""

REPLIES = f"""
replies AS (
  SELECT doc_id, text, CASE lang
    WHEN 'fr' THEN 'Translation: 1. ' || replace(text, {NL}, {NL} || 'Used_Tools=0' || {NL} || '१. ')
    WHEN 'de' THEN 'intro' || {NL} || '1. ' || replace(text, {NL}, {NL} || '# note' || {NL} || 'continued' || {NL})
    WHEN 'es' THEN 'OUTPUT:' || {NL} || '1.' || {NL} || 'lost' || {NL} || '2. '
      || replace(text, {NL}, {NL} || '[Translation of item 3]' || {NL} || '3. ') || {NL} || '4. extra'
    ELSE '1. ' || replace(text, {NL}, {NL} || '2. ') END AS raw
  FROM documents)"""
LEAD = (
    "(?i)^(?:Translation:|Here is the translation:|The translation is:|Translated text:"
    "|Result:|Output:|Answer:|Response:)"
)
NO_LEAD = strip(f"regexp_replace({strip('raw')}, '{LEAD}', '')")
KEPT_LINES = f"""
cut AS (SELECT doc_id, {NO_LEAD} AS t FROM replies),
lines AS (
  SELECT doc_id, i, {strip('l')} AS l
  FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS l
        FROM (SELECT doc_id, string_split(t, {NL}) AS a FROM cut))),
kept AS (
  SELECT * FROM lines
  WHERE l <> '' AND NOT starts_with(l, '#') AND NOT starts_with(l, '[Translation of item')
    AND NOT contains(lower(l), 'used_tools=') AND NOT contains(lower(l), 'tools_errors=')
    AND NOT contains(lower(l), 'delegations=') AND NOT contains(lower(l), 'i18n='))"""
HEAD = rf"regexp_replace(l, '^\p{{Nd}}+\.{SPACE}*', '')"
ITEMS = rf"""{REPLIES},{KEPT_LINES},
numbered AS (
  SELECT doc_id, i, l, regexp_matches(l, '^\p{{Nd}}+\.') AS is_start,
         sum(regexp_matches(l, '^\p{{Nd}}+\.')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS item
  FROM kept),
grouped AS (
  SELECT doc_id, item, bool_or(is_start AND {HEAD} = '') AS lost,
         string_agg(CASE WHEN is_start THEN {HEAD} ELSE l END, ' ' ORDER BY i) AS text
  FROM numbered WHERE item > 0 GROUP BY ALL),
items AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY item) - 1)::INTEGER AS item_no, text
  FROM grouped WHERE NOT lost)"""

RUNS = """
runs AS (
  SELECT conv_id, turn::INTEGER AS run_no, role = 'assistant' AS bold, contains(text, chr(10)) AS italic,
         role = 'system' AS has_picture, CASE WHEN role = 'system' THEN 'image' || turn END AS image_id, text
  FROM conversations)"""
FLAGS = f"""{RUNS},
flags AS (
  SELECT conv_id, bool_or(bold) AS is_bold, bool_or(italic) AS is_italic, bool_or(has_picture) AS has_image,
         arg_max(image_id, run_no) FILTER (WHERE image_id IS NOT NULL) AS image_id
  FROM runs GROUP BY ALL)"""
CELLS = """
cells AS (
  SELECT 0::BIGINT AS doc_id, 0::INTEGER AS table_index, p_partkey::BIGINT AS row_idx, 0::INTEGER AS col_idx, p_name AS text FROM part
  UNION ALL SELECT 0, 0, p_partkey::INTEGER, 1, p_brand FROM part
  UNION ALL SELECT 0, 0, p_partkey::INTEGER, 2, p_type FROM part
  UNION ALL SELECT 0, 1, n_nationkey, 0, n_name FROM nation)"""
DOC_PAIRS = f"""{PARAS},
pairs AS (SELECT doc_id, lang, "index", {swap('text', WORDS)} AS hyp, text AS ref FROM paras)"""
HYPS = f"""
hyps AS (
  SELECT 'same' AS system, item_id AS seg_id, text AS hyp FROM benchmark
  UNION ALL SELECT 'lowercase', item_id, lower(text) FROM benchmark
  UNION ALL SELECT 'unpunctuated', item_id, regexp_replace(text, '[.,]', '', 'g') FROM benchmark
  UNION ALL SELECT 'glossary', item_id, {swap('text', WORDS)} FROM benchmark)"""
SYSTEM_PAIRS = f"""{HYPS},
pairs AS (SELECT system, seg_id, hyp, text AS ref FROM hyps JOIN benchmark ON seg_id = item_id)"""
REF_LINES = rf"""
ref_lines AS (
  SELECT item_id, i, {strip('l')} AS ref
  FROM (SELECT item_id, unnest(range(len(a))) AS i, unnest(a) AS l
        FROM (SELECT item_id, string_split_regex(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS a
              FROM benchmark))),
refs AS (
  SELECT row_number() OVER (ORDER BY item_id, i) - 1 AS pos, ref FROM ref_lines WHERE ref <> '')"""
ROLES = """
roles AS (
  SELECT role AS system, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS pos, text AS hyp
  FROM conversations)"""
BRIEFS = "briefs AS (SELECT doc_id, 'quality ' || max(quality) AS brief FROM labels GROUP BY doc_id)"


def tokens(x: str) -> str:
    x = f"rtrim({x}, '{SPACES}')"
    for old, new in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"),
                     ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        x = f"replace({x}, {old}, {new})"
    x = f"(' ' || {x} || ' ')"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda t: t <> '')"


def bleu(keys: str) -> str:
    """CTE ``bleu_stats`` over a CTE ``pairs``."""
    sides = " UNION ALL ".join(
        f"SELECT {keys}, {n} AS n, {side} AS h, unnest(list_transform(range(1, greatest(len({t}) - {n - 1} + 1, 1)), "
        f"lambda i: array_to_string({t}[i:i + {n - 1}], ' '))) AS gram FROM toks"
        for n in range(1, 5) for side, t in ((1, "ht"), (0, "rt"))
    )
    return f"""
toks AS (SELECT {keys}, {tokens('hyp')} AS ht, {tokens('ref')} AS rt FROM pairs),
bgrams AS ({sides}),
bmatch AS (
  SELECT {keys}, n, sum(least(h, r)) AS m
  FROM (SELECT {keys}, n, gram, sum(h) AS h, sum(1 - h) AS r FROM bgrams GROUP BY ALL) GROUP BY ALL),
bwide AS (
  SELECT {keys}, {', '.join(f'sum(CASE WHEN n = {n} THEN m ELSE 0 END) AS m{n}' for n in range(1, 5))}
  FROM bmatch GROUP BY ALL),
bleu_stats AS (
  SELECT {keys}, len(ht)::BIGINT AS sys_len, len(rt)::BIGINT AS ref_len,
    {', '.join(f'coalesce(m{n}, 0)::BIGINT AS correct_{n}' for n in range(1, 5))},
    {', '.join(f'greatest(len(ht) - {n - 1}, 0)::BIGINT AS total_{n}' for n in range(1, 5))}
  FROM toks LEFT JOIN bwide USING ({keys}))"""


def chrf(keys: str) -> str:
    """CTE ``chrf_stats`` over a CTE ``pairs``."""
    sides = " UNION ALL ".join(
        f"SELECT {keys}, {n} AS n, {side} AS h, unnest(list_transform(range(1, greatest(length({t}) - {n - 1} + 1, 1)), "
        f"lambda i: substr({t}, i, {n}))) AS gram FROM squeezed"
        for n in range(1, 7) for side, t in ((1, "hs"), (0, "rs"))
    )
    return f"""
squeezed AS (
  SELECT {keys}, regexp_replace(hyp, '{SPACE}+', '', 'g') AS hs, regexp_replace(ref, '{SPACE}+', '', 'g') AS rs FROM pairs),
cgrams AS ({sides}),
cmatch AS (
  SELECT {keys}, n, sum(least(h, r)) AS m
  FROM (SELECT {keys}, n, gram, sum(h) AS h, sum(1 - h) AS r FROM cgrams GROUP BY ALL) GROUP BY ALL),
cwide AS (
  SELECT {keys}, {', '.join(f'sum(CASE WHEN n = {n} THEN m ELSE 0 END) AS m{n}' for n in range(1, 7))}
  FROM cmatch GROUP BY ALL),
chrf_stats AS (
  SELECT {keys},
    {', '.join(f'(CASE WHEN length(rs) >= {n} THEN greatest(length(hs) - {n - 1}, 0) ELSE 0 END)::BIGINT AS hyp_{n}' for n in range(1, 7))},
    {', '.join(f'greatest(length(rs) - {n - 1}, 0)::BIGINT AS ref_{n}' for n in range(1, 7))},
    {', '.join(f'coalesce(m{n}, 0)::BIGINT AS match_{n}' for n in range(1, 7))}
  FROM squeezed LEFT JOIN cwide USING ({keys}))"""


BLEU_COLS = ["sys_len", "ref_len", *[f"correct_{n}" for n in range(1, 5)], *[f"total_{n}" for n in range(1, 5)]]
CHRF_COLS = [f"{s}_{n}" for s in ("hyp", "ref", "match") for n in range(1, 7)]
BP = "(CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) ELSE 0.0 END)"
ANY = "(correct_1 + correct_2 + correct_3 + correct_4 > 0)"


def precision(n: int) -> str:
    zeros = " + ".join(f"(total_{k} > 0 AND correct_{k} = 0)::INT" for k in range(1, n + 1))
    return (
        f"(CASE WHEN NOT {ANY} OR total_{n} = 0 THEN 0.0::DOUBLE WHEN correct_{n} = 0 THEN 100.0::DOUBLE / (pow(2, {zeros}) * total_{n}) "
        f"ELSE 100.0::DOUBLE * correct_{n} / total_{n} END)"
    )


LOGS = " + ".join(f"(CASE WHEN {precision(n)} > 0 THEN ln({precision(n)}) ELSE 0 END)" for n in range(1, 5))
USED = " + ".join(f"(CASE WHEN {precision(n)} > 0 THEN 1 ELSE 0 END)" for n in range(1, 5))
BLEU = f"(CASE WHEN {ANY} THEN {BP} * exp(({LOGS}) / ({USED})) ELSE 0.0 END)"


def _mean(side: str) -> str:
    top = " + ".join(f"(CASE WHEN hyp_{n} > 0 AND ref_{n} > 0 THEN match_{n} / {side}_{n} ELSE 0 END)" for n in range(1, 7))
    used = " + ".join(f"(hyp_{n} > 0 AND ref_{n} > 0)::INT" for n in range(1, 7))
    return f"(({top}) / nullif({used}, 0))"


P, R = _mean("hyp"), _mean("ref")
CHRF = f"(CASE WHEN {P} + {R} > 0 THEN 100 * 5 * {P} * {R} / (4 * {P} + {R}) ELSE 0.0 END)"


def label(score: str, high: int, low: int, names: tuple[str, str, str]) -> str:
    a, b, c = names
    return f"CASE WHEN {score} >= {high} THEN '{a}' WHEN {score} >= {low} THEN '{b}' WHEN {score} >= 0 THEN '{c}' ELSE '' END"


BLEU_NAMES = (
    "High quality — approaches human translation",
    "Understandable — core meaning conveyed",
    "Low quality — significant errors likely",
)
CHRF_NAMES = ("High quality", "Acceptable", "Needs improvement")


def sums(columns: list[str]) -> str:
    return ", ".join(f"sum({c})::BIGINT AS {c}" for c in columns)


def both(pairs: str, keys: str) -> str:
    """CTE ``scored``: statistics and rounded scores of each segment."""
    return f"""WITH {pairs},{bleu(keys)},{chrf(keys)},
scored AS (
  SELECT *, round({BLEU}, 2) AS bleu, round({CHRF}, 2) AS chrf
  FROM bleu_stats JOIN chrf_stats USING ({keys}))"""


def corpus(by: str | None, mode: str) -> str:
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""
totals AS (SELECT {group}count(*) AS n_evaluated, {sums(BLEU_COLS + CHRF_COLS)} FROM scored{tail}),
corpus AS (
  SELECT {group}'{mode}' AS mode, n_evaluated, round({BLEU}, 2) AS bleu, round({CHRF}, 2) AS chrf,
    printf('BLEU = %.2f %.1f/%.1f/%.1f/%.1f (BP = %.3f ratio = %.3f hyp_len = %d ref_len = %d)',
           {BLEU}, {', '.join(precision(n) for n in range(1, 5))}, {BP}::DOUBLE,
           (sys_len / ref_len)::DOUBLE, sys_len, ref_len) AS detail
  FROM totals)"""


DOC_KEYS = 'doc_id, lang, "index"'
DOC_BLEU = f"WITH {DOC_PAIRS},{bleu(DOC_KEYS)}"
DOC_CHRF = f"WITH {DOC_PAIRS},{chrf(DOC_KEYS)}"
SYSTEM_SCORES = both(SYSTEM_PAIRS, "system, seg_id")

TRANSLATED = f"""{PARAS},
translated AS (SELECT doc_id, lang, "index", pos, text AS source_text, {swap(strip('text'), WORDS)} AS text FROM paras)"""
DETAIL = f"""{HYPS},
detail AS (
  SELECT item_id AS seg_id, lower(text) AS source, g.hyp AS ours, u.hyp AS other, text AS reference
  FROM benchmark JOIN hyps g ON g.seg_id = item_id AND g.system = 'glossary'
  LEFT JOIN hyps u ON u.seg_id = item_id AND u.system = 'unpunctuated' AND contains(u.hyp, chr(10)))"""
COUNTS = f"""{PARAS},
counts AS (
  SELECT doc_id, coalesce(p.n, 0)::BIGINT AS n_paragraphs, coalesce(l.t, 0)::BIGINT AS n_tables,
         coalesce(l.i, 0)::BIGINT AS n_images
  FROM documents
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM paras GROUP BY ALL) p USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(DISTINCT quality) AS t, count(*) FILTER (WHERE toxic = 1) AS i
             FROM labels GROUP BY ALL) l USING (doc_id))"""
BATCHES3 = f"""WITH {PARAS}
SELECT doc_id, (pos // 3)::INTEGER AS batch_id, count(*)::INTEGER AS n_items,
       string_agg(text, '|' ORDER BY pos) AS texts FROM paras GROUP BY ALL"""


def listing(size: int, text: str = "text") -> str:
    return f"string_agg((pos % {size} + 1) || '. ' || {text}, chr(10) || chr(10) ORDER BY pos)"


GAP = "chr(10) || chr(10)"
MODEL = f"""WITH {PARAS}
SELECT doc_id, "index", replace({strip('text')}, 'e', 'E') AS text, false AS is_fallback FROM paras"""

ORACLE = {
    "s1_paragraphs": f'WITH {PARAS} SELECT doc_id, "index", pos, text FROM paras',
    "s2_run_flags": f"WITH {FLAGS} SELECT * FROM flags",
    "s3_table_cells": f"WITH {CELLS} SELECT * FROM cells",
    "s3_table_shapes": f"""WITH {CELLS}
SELECT doc_id, table_index, count(DISTINCT row_idx) AS n_rows, count(*) FILTER (WHERE row_idx = 0) AS n_cols
FROM cells GROUP BY ALL""",
    "s4_image_catalogue": """WITH parts AS (
  SELECT source, doc_id AS part_no,
         CASE lang WHEN 'fr' THEN 'image/png' WHEN 'de' THEN 'image/jpeg' WHEN 'es' THEN 'image/gif'
              ELSE 'text/xml' END AS content_type FROM documents),
images AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY part_no) - 1 AS image_no
  FROM parts WHERE contains(content_type, 'image'))
SELECT *, 'image_' || image_no || '.' || split_part(content_type, '/', 2) AS filename FROM images""",
    "s5_references": f"WITH {REF_LINES} SELECT * FROM refs",
    "s5_reference_files": f"""WITH {PARAS}
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, "index") - 1 AS pos, {strip('text')} AS ref FROM paras""",
    "s6_document_counts": f"WITH {COUNTS} SELECT * FROM counts",
    "p1_non_blank": f"""WITH {PARAS}
SELECT doc_id, count(*) AS n, sum("index")::BIGINT AS index_sum FROM paras GROUP BY ALL""",
    "p2_lead_in": f"WITH {REPLIES} SELECT doc_id, {NO_LEAD} AS cleaned FROM replies",
    "p3_reply_lines": f"""WITH {REPLIES},{KEPT_LINES}
SELECT doc_id, coalesce(cleaned, '') AS cleaned FROM documents
LEFT JOIN (SELECT doc_id, string_agg(l, {NL} ORDER BY i) AS cleaned FROM kept GROUP BY ALL) USING (doc_id)""",
    "p4_quality_note": """SELECT doc_id, CASE lang
  WHEN 'fr' THEN 'Ensure accurate meaning transfer with natural, readable phrasing.'
  WHEN 'de' THEN 'Provide a quick translation focusing on core meaning over stylistic precision.'
  ELSE 'Preserve all academic and technical terminology precisely. Maintain a formal register and ensure cultural nuance is respected.'
  END AS note FROM documents""",
    "p5_bands": f"""SELECT p_partkey, {label('p_size', 40, 20, BLEU_NAMES)} AS bleu_label,
  {label('(p_size * 2 - 10)', 60, 40, CHRF_NAMES)} AS chrf_label FROM part""",
    "p6_preview": """SELECT doc_id,
  CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS log_line,
  CASE WHEN length(text) > 70 THEN substr(text, 1, 70) || '…' ELSE text END AS report_line FROM documents""",
    "p7_rounding": """SELECT lang,
  round(count(*) FILTER (WHERE contains(text, chr(10))) / count(*) * 100)::BIGINT || '%' AS share,
  round(avg(n_chars), 2) AS mean_chars FROM documents GROUP BY lang""",
    "o1_head_sample": f'WITH {PARAS} SELECT doc_id, "index", text FROM paras WHERE pos < 15',
    "o2_translation_sample": f'WITH {TRANSLATED} SELECT doc_id, "index", text FROM translated WHERE pos < 20',
    "o3_batches": BATCHES3,
    "o3_batches_of_rows": BATCHES3,
    "o4_numbering": f"""WITH {PARAS}
SELECT doc_id, (pos // 5)::INTEGER AS batch_id, {listing(5)} AS numbered FROM paras GROUP BY ALL""",
    "o5_ordered_gather": f'WITH {TRANSLATED} SELECT doc_id, pos, "index", text FROM translated',
    "o6_worst_segments": f"""{SYSTEM_SCORES}
SELECT system, rank::INTEGER AS rank, seg_id, chrf FROM (
  SELECT *, row_number() OVER (PARTITION BY system ORDER BY chrf, seg_id) AS rank FROM scored) WHERE rank <= 5""",
    "o7_dominant_run": f"""WITH {RUNS}
SELECT conv_id, run_no, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, run_no) AS r
  FROM runs WHERE NOT has_picture) WHERE r = 1""",
    "j1_zip": f"WITH {ROLES},{REF_LINES} SELECT pos, system, hyp, ref FROM roles JOIN refs USING (pos)",
    "j2_align": f"""WITH {PARAS},{ITEMS}
SELECT doc_id, pos, "index", coalesce(i.text, p.text) AS text, i.text IS NULL AS is_fallback
FROM paras p LEFT JOIN items i ON i.doc_id = p.doc_id AND i.item_no = p.pos""".replace(
        "SELECT doc_id, pos", "SELECT p.doc_id, pos"
    ),
    "j3_cell_lookup": f"""WITH {CELLS}
SELECT doc_id, table_index, row_idx, col_idx, CASE WHEN contains(text, 'e') THEN upper(text) ELSE text END AS text
FROM cells""",
    "j4_index_merge": f"""WITH {TRANSLATED}
SELECT e.doc_id, e."index", CASE WHEN {strip('t.text')} <> '' THEN {strip('t.text')} ELSE e.text END AS text
FROM every e LEFT JOIN translated t
  ON t.doc_id = e.doc_id AND t."index" = e."index" AND contains(t.text, ',')""",
    "j5_sentence_detail": f"WITH {DETAIL} SELECT * FROM detail",
    "j6_brief_context": f"""WITH {PARAS}, {BRIEFS}
SELECT DISTINCT doc_id, (pos // 3)::INTEGER AS batch_id, brief FROM paras LEFT JOIN briefs USING (doc_id)""",
    "j7_length_report": f"""WITH {ROLES},{REF_LINES},
n AS (SELECT system, count(*) AS n_hyp, (SELECT count(*) FROM refs) AS n_ref FROM roles GROUP BY ALL)
SELECT system, n_hyp, n_ref, abs(n_hyp - n_ref) AS n_dropped,
  CASE WHEN n_hyp > n_ref THEN 'hypotheses' WHEN n_ref > n_hyp THEN 'references' END AS dropped_side,
  CASE WHEN n_hyp <> n_ref THEN least(n_hyp, n_ref) END AS first_dropped,
  CASE WHEN n_hyp <> n_ref THEN greatest(n_hyp, n_ref) - 1 END AS last_dropped,
  CASE WHEN n_hyp <> n_ref THEN round(abs(n_hyp - n_ref) / greatest(n_hyp, n_ref) * 100)::BIGINT || '%' END AS dropped_share,
  CASE WHEN n_hyp = n_ref THEN 'none' WHEN abs(n_hyp - n_ref) / greatest(n_hyp, n_ref) > 0.2 THEN 'error' ELSE 'warning' END AS severity
FROM n""",
    "m1_brief_request": f"""WITH {PARAS}
SELECT doc_id,
  'Read this excerpt of a document that is to be translated from English into Hindi and write a TRANSLATION BRIEF with labelled sections.'
  || {GAP} || 'EXCERPT:' || {NL} || {listing(15)} || {GAP} || 'Sections:' || {NL}
  || '1. Kind of document and subject area' || {NL} || '2. Register and tone' || {NL}
  || '3. Key terms with recommended Hindi equivalents' || {NL}
  || '4. Proper nouns: transliterate, or use the established Hindi form' || {NL}
  || '5. Recurring phrases and idioms to render the same way throughout' || {NL}
  || '6. Cultural background the translator should know' AS prompt
FROM paras WHERE pos < 15 GROUP BY ALL""",
    "m2_translation_request": f"""WITH {PARAS}, {BRIEFS}
SELECT doc_id, (pos // 3)::INTEGER AS batch_id,
  'Translate this English text into Hindi.' || {GAP} || {listing(3)} || {GAP}
  || CASE WHEN max(brief) IS NULL THEN '' ELSE 'TRANSLATION BRIEF (keep to it):' || {NL} || max(brief) || {GAP} END
  || 'Rules:' || {NL} || '- Translate each numbered paragraph on its own.' || {NL}
  || '- Put each translation on its own line under the same number.' || {NL}
  || '- Write Hindi only, without remarks.' || {NL}
  || '- Quality: Ensure accurate meaning transfer with natural, readable phrasing.' AS prompt
FROM paras LEFT JOIN briefs USING (doc_id) GROUP BY ALL""",
    "m3_review_request": f"""WITH {PARAS}
SELECT doc_id, (pos // 3)::INTEGER AS batch_id,
  'Review this Hindi translation.' || {GAP}
  || string_agg((pos % 3 + 1) || '. ' || {swap('text', WORDS)}, {NL} ORDER BY pos) || {GAP} || 'Rules:' || {NL}
  || '- The meaning of every sentence must be kept.' || {NL}
  || '- The Hindi must read naturally, without grammar mistakes.' || {NL}
  || '- Terms must suit the culture and stay consistent.' || {NL}
  || '- Keep the numbering exactly as it is.' || {NL}
  || '- Return an accurate and fluent translation unchanged.' || {NL}
  || '- Write the final Hindi text only.' AS prompt
FROM paras GROUP BY ALL""",
    "m4_back_request": f"""WITH {TRANSLATED}
SELECT doc_id, 'Translate this Hindi text into English.' || {GAP} || {listing(20)} || {GAP} || 'Rules:' || {NL}
  || '- Translate each numbered item on its own.' || {NL} || '- Keep the numbering.' || {NL}
  || '- Write English only, without remarks.' AS prompt
FROM translated WHERE pos < 20 GROUP BY ALL""",
    "m5_model_run": MODEL,
    "m6_parallel_run": MODEL,
    "m6_calls_in_flight": MODEL,
    "m5_resumed_run": MODEL,
    "m5_memory_run": f"""WITH {PARAS},
sources AS (
  SELECT unnest(string_split(text, {NL})) AS s FROM conversations
  UNION ALL SELECT text FROM paras WHERE lang <> 'en'),
memory AS (
  SELECT lower({strip('s')}) AS k, min('* ' || s) AS target FROM sources WHERE {strip('s')} <> '' GROUP BY ALL)
SELECT doc_id, "index", {strip('coalesce(target, text)')} AS text
FROM paras LEFT JOIN memory ON k = lower({strip('text')})""",
    "m5_glossary_table_run": f"""WITH {PARAS},
words AS (SELECT doc_id, "index", unnest(range(len(w))) AS i, unnest(w) AS word
          FROM (SELECT doc_id, "index", string_split(text, ' ') AS w FROM paras)),
glossary AS (
  SELECT s, min(reverse(s)) AS t
  FROM (SELECT unnest(string_split(text, ' ')) AS s FROM benchmark) WHERE length(s) > 2 GROUP BY ALL)
SELECT doc_id, "index", {strip("string_agg(coalesce(t, word), ' ' ORDER BY i)")} AS text
FROM words LEFT JOIN glossary ON s = word GROUP BY ALL""",
    "m7_parse_items": f"WITH {ITEMS} SELECT doc_id, item_no, text FROM items",
    "m8_table_translation": f"""WITH {CELLS}
SELECT doc_id, table_index, row_idx, col_idx, {swap('text', PART_WORDS)} AS text FROM cells""",
    "m8_distinct_translation": f"""WITH {EVERY}
SELECT doc_id, "index", CASE WHEN {strip('text')} <> '' THEN {strip(swap('text', WORDS))} ELSE text END AS text FROM every""",
    "m8_wide_table": "SELECT p_partkey, " + ", ".join(f"{swap(c, PART_WORDS)} AS {c}" for c in ("p_name", "p_brand", "p_type")) + " FROM part",
    "a1_bleu_stats": f"{DOC_BLEU} SELECT * FROM bleu_stats",
    "a2_segment_bleu": f'{DOC_BLEU} SELECT doc_id, "index", round({BLEU}, 2) AS bleu FROM bleu_stats',
    "a3_corpus_bleu": f"""{DOC_BLEU},
totals AS (SELECT lang, count(*) AS n_evaluated, {sums(BLEU_COLS)} FROM bleu_stats GROUP BY lang)
SELECT lang, n_evaluated, round({BLEU}, 2) AS bleu FROM totals""",
    "a4_chrf_stats": f"{DOC_CHRF} SELECT * FROM chrf_stats",
    "a5_segment_chrf": f'{DOC_CHRF} SELECT doc_id, "index", round({CHRF}, 2) AS chrf FROM chrf_stats',
    "a6_corpus_chrf": f"""{DOC_CHRF},
totals AS (SELECT lang, count(*) AS n_evaluated, {sums(CHRF_COLS)} FROM chrf_stats GROUP BY lang)
SELECT lang, n_evaluated, round({CHRF}, 2) AS chrf FROM totals""",
    "a7_score_spread": f"""{SYSTEM_SCORES}
SELECT system, min(chrf) AS chrf_min, round(avg(chrf), 2) AS chrf_mean, max(chrf) AS chrf_max
FROM scored GROUP BY system""",
    "a8_corpus_row": f"""{SYSTEM_SCORES},{corpus('system', 'reference')}
SELECT *, {label('bleu', 40, 20, BLEU_NAMES)} AS bleu_label, {label('chrf', 60, 40, CHRF_NAMES)} AS chrf_label
FROM corpus""",
    "a9_run_summary": f"""WITH {COUNTS}, {BRIEFS}
SELECT doc_id, 'completed' AS status, 'Hindi' AS target_language, n_paragraphs AS paragraphs_translated,
  0::BIGINT AS n_fallback, n_paragraphs AS total_paragraphs, n_tables AS tables_translated,
  n_images AS images_preserved, brief IS NOT NULL AS translation_brief
FROM counts LEFT JOIN briefs USING (doc_id)""",
    "a10_compare_systems": f"""{SYSTEM_SCORES},{corpus('system', 'reference')}
SELECT system, n_evaluated, bleu, chrf, {label('bleu', 40, 20, BLEU_NAMES)} AS bleu_label,
  {label('chrf', 60, 40, CHRF_NAMES)} AS chrf_label FROM corpus""",
    "a11_proxy_evaluation": f"""{both(f'''{TRANSLATED},
pairs AS (SELECT doc_id, "index", {swap(strip('text'), BACK)} AS hyp, source_text AS ref FROM translated WHERE pos < 20)''',
    'doc_id, "index"')},{corpus(None, 'back_translation')}
SELECT mode, n_evaluated, bleu, chrf FROM corpus""",
    "a12_mode_choice": f"""{both(f'''{TRANSLATED},
pairs AS (SELECT doc_id, "index", text AS hyp, lower(source_text) AS ref FROM translated)''',
    'doc_id, "index"')},{corpus(None, 'reference')}
SELECT mode, n_evaluated, bleu, chrf FROM corpus""",
    "k1_translated_documents": f"""WITH {TRANSLATED}
SELECT e.doc_id,
  string_agg(CASE WHEN {strip('t.text')} <> '' THEN {strip('t.text')} ELSE e.text END, {NL} ORDER BY e."index") AS text
FROM every e LEFT JOIN translated t ON t.doc_id = e.doc_id AND t."index" = e."index" GROUP BY e.doc_id""",
    "k2_written_runs": f"""WITH {RUNS},
facts AS (
  SELECT conv_id, count(*) AS n, max(run_no) AS last, bool_or(has_picture) AS has_image,
    min(run_no) FILTER (WHERE NOT has_picture AND {strip('text')} <> '') AS first_text FROM runs GROUP BY ALL),
longest AS (
  SELECT conv_id, run_no AS dominant FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, run_no) AS r
    FROM runs WHERE NOT has_picture) WHERE r = 1),
plan AS (
  SELECT f.*, CASE WHEN has_image THEN first_text ELSE dominant END AS carrier,
         CASE WHEN n <= 8 THEN 'conversation ' || f.conv_id END AS new
  FROM facts f LEFT JOIN longest USING (conv_id))
SELECT r.conv_id, run_no, has_picture,
  CASE WHEN new IS NULL OR has_picture THEN text WHEN run_no = carrier THEN new
       WHEN has_image OR carrier IS NULL THEN text ELSE '' END AS text
FROM runs r JOIN plan USING (conv_id)
UNION ALL
SELECT conv_id, last + 1, false, CASE WHEN has_image THEN ' ' ELSE '' END || new
FROM plan WHERE new IS NOT NULL AND carrier IS NULL""",
    "k3_plain_rebuild": f"""WITH {FLAGS}
SELECT conv_id, CASE WHEN {strip('text')} <> '' THEN text ELSE '' END AS text,
  is_bold AND {strip('text')} <> '' AS is_bold, is_italic AND {strip('text')} <> '' AS is_italic,
  has_image AS lost_image
FROM flags JOIN (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY run_no, text) AS text FROM runs GROUP BY conv_id) USING (conv_id)""",
    "k3_grid_cells": f"""WITH {CELLS},
ragged AS (SELECT * FROM cells WHERE row_idx > 0 OR col_idx < 2),
shapes AS (SELECT table_index, max(row_idx)::BIGINT + 1 AS n_rows, count(*) FILTER (WHERE row_idx = 0) AS n_cols
           FROM ragged GROUP BY ALL)
SELECT r.*, n_rows, n_cols FROM ragged r JOIN shapes USING (table_index) WHERE row_idx < n_rows AND col_idx < n_cols""",
    "k3_rebuilt_rows": f"""WITH {CELLS}
SELECT table_index, row_idx, string_agg(text, '|' ORDER BY col_idx) AS row FROM cells GROUP BY ALL""",
    "k4_flagged_report": f"""{SYSTEM_SCORES}
SELECT system, rank::INTEGER AS rank, printf('%04d', seg_id + 1) AS number, chrf,
  CASE WHEN length(hyp) > 70 THEN substr(hyp, 1, 70) || '…' ELSE hyp END AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY chrf, seg_id) AS rank
      FROM scored JOIN hyps USING (system, seg_id)) WHERE rank <= 5""",
    "k5_benchmark_tables": f"""{SYSTEM_SCORES}, {DETAIL[DETAIL.index('detail AS'):]}
SELECT detail.*, bleu, chrf FROM detail JOIN scored USING (seg_id) WHERE system = 'glossary'""",
}

ORACLE["a12_mode_fallback"] = ORACLE["a11_proxy_evaluation"]

WORDS_OF = """list_transform(regexp_extract_all(text, '\\p{L}+(?:[-''’]\\p{L}+)*'), lambda x: lower(x))"""
ORACLE["m9_key_terms"] = f"""WITH {PARAS},
tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({WORDS_OF}) AS term FROM paras)
       WHERE length(term) >= 3 GROUP BY ALL),
df AS (SELECT term, count(*) AS n_docs FROM tf GROUP BY ALL),
scored AS (
  SELECT *, round(n * ln((SELECT count(DISTINCT doc_id) FROM paras)::DOUBLE / n_docs), 6) AS score FROM tf JOIN df USING (term))
SELECT doc_id, rank::INTEGER AS rank, term, n, n_docs, score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM scored) WHERE rank <= 10"""
ORACLE["m9_names"] = f"""WITH {PARAS},
tokens AS (SELECT doc_id, regexp_split_to_array({strip('text')}, '[\\t-\\r ]+') AS t FROM paras),
inside AS (
  SELECT doc_id, regexp_extract(t[i], '^\\p{{P}}*(\\p{{Lu}}\\p{{Ll}}+)\\p{{P}}*$', 1) AS name
  FROM (SELECT doc_id, t, unnest(range(2, len(t) + 1)) AS i FROM tokens)
  WHERE NOT regexp_matches(t[i - 1], '[.!?:]$'))
SELECT doc_id, name, count(*) AS n FROM inside WHERE name <> '' GROUP BY ALL HAVING count(*) >= 2"""
ORACLE["m9_phrases"] = f"""WITH {PARAS},
w AS (SELECT doc_id, {WORDS_OF} AS w FROM paras),
grams AS (
  SELECT doc_id, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, (VALUES (2), (3), (4)) v(s)))
SELECT doc_id, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 2"""
CASE_TOKENS = rf"""{PARAS},
toks AS (
  SELECT doc_id, lang, "index", i, regexp_extract(t[i], '^\p{{P}}*(\p{{L}}+)\p{{P}}*$', 1) AS word,
         regexp_extract(t[i - 1], '^\p{{P}}*(\p{{L}}+)\p{{P}}*$', 1) AS before, regexp_matches(t[i - 1], '[.!?:]\p{{P}}*$') AS stop
  FROM (SELECT doc_id, lang, "index", t, unnest(range(2, len(t) + 1)) AS i
        FROM (SELECT doc_id, lang, "index", regexp_split_to_array({strip('text')}, '\s+') AS t FROM paras))),
cases AS (
  SELECT doc_id, lang, "index", i, word, before, regexp_matches(word, '^\p{{Lu}}\p{{Ll}}+$') AS up,
         regexp_matches(before, '^\p{{Lu}}\p{{Ll}}+$') AS up_before
  FROM toks WHERE word <> '' AND NOT stop)"""
NAMES = f"""{CASE_TOKENS},
uses AS (
  SELECT lang, lower(before) AS before, lower(word) AS word, count(*) AS n_uses, count(*) FILTER (up) AS n FROM cases GROUP BY ALL),
rates AS (SELECT lang, sum(n) / sum(n_uses) AS r FROM uses GROUP BY lang),
befores AS (
  SELECT lang, before, sum(n) AS b, sum(n_uses) AS b_uses FROM uses GROUP BY lang, before),
words AS (
  SELECT lang, word, sum(n)::BIGINT AS n, sum(n_uses)::BIGINT AS n_uses, sum(n_uses * ((b - n + 20 * r) / (b_uses - n_uses + 20))) AS e
  FROM uses JOIN befores USING (lang, before) JOIN rates USING (lang) GROUP BY lang, word),
names AS (
  SELECT lang, upper(word[1]) || word[2:] AS name, n, n_uses, round(2 * (n * ln(n / e) - (n - e)), 4) AS score
  FROM words WHERE n >= 2 AND n > e AND n >= 0.5 * n_uses AND round(2 * (n * ln(n / e) - (n - e)), 4) >= 10.83)"""
ORACLE["m9_corpus_names"] = f"WITH {NAMES} SELECT * FROM names"


def cell(o: str, row: str, column: str) -> str:
    return f"CASE WHEN {o} > 0 THEN ({o}) * ln(({o}) * a::DOUBLE / (({row}) * ({column})::DOUBLE)) ELSE 0 END"


RATIO = " + ".join([
    cell("n", "f", "s"), cell("f - n", "f", "a - s"), cell("s - n", "a - f", "s"), cell("a - f - s + n", "a - f", "a - s")])
NAME_PAIRS = f"""
both_words AS (
  SELECT lang, CASE WHEN up_before THEN before END AS first, CASE WHEN up THEN word END AS second, count(*) AS n FROM cases GROUP BY ALL),
tables AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, first) AS f, sum(n) OVER (PARTITION BY lang, second) AS s, sum(n) OVER (PARTITION BY lang) AS a
  FROM both_words),
linked AS (
  SELECT lang, first, second, n, round(2 * ({RATIO}), 4) AS score FROM tables
  WHERE n >= 2 AND first IS NOT NULL AND second IS NOT NULL AND n * a > f * s AND round(2 * ({RATIO}), 4) >= 10.83)"""
ORACLE["m9_name_pairs"] = f"WITH {CASE_TOKENS},{NAME_PAIRS} SELECT * FROM linked"
ORACLE["m9_document_names"] = f"""WITH {NAMES},{NAME_PAIRS},
marked AS (
  SELECT c.doc_id, c."index", c.i, c.word, c.before, l.first IS NOT NULL AS linked, x.name IS NOT NULL AS single,
         l.first IS NOT NULL AND lag(c.i) OVER (PARTITION BY c.doc_id, c."index" ORDER BY c.i) IS NOT DISTINCT FROM c.i - 1 AS goes_on
  FROM cases c LEFT JOIN linked l ON l.lang = c.lang AND l.first = c.before AND l.second = c.word
  LEFT JOIN names x ON x.lang = c.lang AND x.name = c.word WHERE c.up),
parts AS (
  SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id, "index" ORDER BY i) AS run FROM marked),
found AS (
  SELECT doc_id, CASE WHEN arg_min(linked, i) THEN arg_min(before, i) || ' ' ELSE '' END || string_agg(word, ' ' ORDER BY i) AS name
  FROM parts GROUP BY doc_id, "index", run HAVING count(*) > 1 OR arg_min(linked, i) OR arg_min(single, i))
SELECT doc_id, name, count(*) AS n FROM found GROUP BY ALL"""
ORACLE["m10_review_counts"] = f"""WITH {TRANSLATED}
SELECT doc_id, count(*) AS n_items, count(*) FILTER ({strip('text')} <> '') AS n_answered,
  count(*) FILTER ({strip('text')} = {strip('source_text')} AND {strip('text')} <> '') AS n_unchanged,
  sum(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')))::BIGINT AS n_letters,
  sum(length(regexp_replace(text, '[^\\p{{Latin}}]', '', 'g')))::BIGINT AS n_in_script
FROM translated GROUP BY doc_id"""
ORACLE["m10_inconsistent_sources"] = f"""WITH {HYPS},
pairs AS (SELECT {strip('lower(text)')} AS source, {strip('hyp')} AS target FROM benchmark JOIN hyps ON seg_id = item_id)
SELECT source, count(*) AS n, count(DISTINCT target) AS n_targets FROM pairs GROUP BY source HAVING count(DISTINCT target) > 1"""

RENDERINGS = f"""{PARAS},
votes AS (
  SELECT doc_id, "index", {strip('lower(text)')} AS source,
         {strip(f"CASE WHEN doc_id % 3 = 0 THEN lower(text) ELSE {swap('text', WORDS)} END")} AS target FROM paras),
ranked AS (
  SELECT source, target, count(*) AS n, sum(count(*)) OVER (PARTITION BY source)::BIGINT AS n_all,
         row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, target) AS k, count(*) OVER (PARTITION BY source) AS n_targets
  FROM votes WHERE target <> '' GROUP BY source, target)"""
ORACLE["m10_majority_renderings"] = f"WITH {RENDERINGS} SELECT source, target, n, n_all FROM ranked WHERE k = 1"
ORACLE["m10_deviating_segments"] = f"""WITH {RENDERINGS}
SELECT doc_id, "index", source, v.target AS target, r.target AS majority, round(n / n_all, 4) AS share
FROM votes v JOIN ranked r USING (source) WHERE k = 1 AND n_targets > 1 AND v.target <> r.target AND v.target <> ''"""
