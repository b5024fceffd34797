"""DuckDB SQL oracles for the registered queries (tables are pre-registered views).

The oracles are written relationally on purpose: where the Spark side scores tokens with
higher-order functions over arrays, the SQL unnests tokens, joins the lexicon and groups; where
Spark numbers rows with per-partition offsets, the SQL uses a window. Both sides use the same
rounding formulas so that doubles compare exactly.

Regex notes: DuckDB uses RE2 (no look-around, ``\\1`` in replacements, ``'g'`` for all matches,
ASCII ``\\s``), so Java's Unicode ``(?U)\\s`` is spelled out as a character class.
"""

from __future__ import annotations

import re

from tonekit.functions.numeric import AS_A, AS_P
from tonekit.operators.boundaries import (
    ABBREVIATION_SCORE, ABBREVIATION_SHARE, RX_LEAD, RX_TAIL, RX_TYPE, STARTER_RATIO,
)
from tonekit.functions.patterns import (
    CLASS_LABELS, DEFAULT_INFO, NO_LANGUAGE, RX_BOILER, RX_FOOTNOTE, RX_NOISE, RX_TITLES,
)
from tonekit.sources.lexicon import (
    BOOST, BOOSTERS, DAMPERS, DECAY, NEGATION_FACTOR, NEGATION_REACH, NEGATORS, lexicon_values_sql,
)

# Java (?U)\s, spelled out for RE2.
WS = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS_ASCII = r"\t\n\x{0B}\f\r "
SENT_RX = r"""([.!?]+["'')\]]*)[\t\n\x{0B}\f\r ]+"""    # quote doubled for the SQL literal
POST_RX = rf"http[^{WS}]+|#[^{WS}]+|@[^{WS}]+"
HREF_RX = r"""(?i)<a\s[^>]*href\s*=\s*"([^"]*)\""""
LEX = lexicon_values_sql()

# --- fixed values: character references that occur in the given pages ---
# (name, character, legacy): legacy references also decode without the closing semicolon (HTML5).
# "&amp;" goes last so that "&amp;lt;" becomes "&lt;" and not "<".
ENTITY_TABLE = (
    ("lt", "<", True), ("gt", ">", True), ("quot", '"', True), ("#39", "'", True), ("apos", "'", False),
    ("nbsp", "\u00a0", True), ("copy", "\u00a9", True), ("reg", "\u00ae", True), ("middot", "\u00b7", True),
    ("laquo", "\u00ab", True), ("raquo", "\u00bb", True), ("ndash", "\u2013", False),
    ("mdash", "\u2014", False), ("hellip", "\u2026", False), ("euro", "\u20ac", False), ("amp", "&", True),
)
# --- end of fixed values ---


def entity_pattern(name: str, legacy: bool) -> str:
    return f"&{name};?" if legacy else f"&{name};"


def element_pattern(tag: str, css_class: str | None = None) -> str:
    """Regex whose group 1 is the inner markup of the first ``<tag>``; enough for pages without nested elements."""
    t = re.escape(tag)
    if css_class is None:
        return rf"(?is)<{t}(?:\s[^>]*)?>(.*?)</{t}\s*>"
    cls = re.escape(css_class)
    return rf"""(?is)<{t}\s[^>]*class\s*=\s*["'](?:[^"']*\s)?{cls}(?:\s[^"']*)?["'][^>]*>(.*?)</{t}\s*>"""



def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+$', '')"


def dbl(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def rhu(x: str, digits: int) -> str:
    s = dbl(float(10 ** digits))
    return f"(floor(({x}) * {s} + {dbl(0.5)}) / {s})"


def r6(x: str) -> str:
    return rhu(x, 6)


def np_round(x: str, digits: int) -> str:
    s = dbl(float(10 ** digits))
    return f"(round_even(({x}) * {s}, 0) / {s} + {dbl(0.0)})"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}]+'), lambda t: t <> '')"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '{SENT_RX}', '\\1' || chr(31), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(31)), lambda s: {strip('s')}), lambda s: s <> '')"


def not_noise(x: str) -> str:
    return f"NOT regexp_matches({x}, {q(RX_NOISE)})"


def decode(x: str) -> str:
    for name, ch, legacy in ENTITY_TABLE:
        x = f"regexp_replace({x}, {q(entity_pattern(name, legacy))}, {q(ch)}, 'g')"
    return x


def element_text(html: str, tag: str, cls: str | None = None) -> str:
    p = q(element_pattern(tag, cls))
    inner = f"regexp_replace(regexp_extract({html}, {p}, 1), '<[^>]*>', '', 'g')"
    return f"(CASE WHEN regexp_matches({html}, {p}) THEN {rstrip(decode(inner))} END)"


def default_if_blank(x: str, default: str) -> str:
    return f"coalesce(nullif({strip(x)}, ''), {q(default)})"


def parse_date(x: str) -> str:
    t = strip(x)
    fmts = ["%B %d, %Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y"]
    return "CAST(coalesce(" + ", ".join(f"try_strptime({t}, '{f}')" for f in fmts) + ") AS DATE)"


def split_part(x: str, delim: str, n: int) -> str:
    return f"nullif({strip(f'split_part({x}, {q(delim)}, {n})')}, '')"


def cls(x: str, edges=(-1.0, -0.00001, 0.00001, 1.0)) -> str:
    lo, b1, b2, hi = (dbl(e) for e in edges)
    return (f"(CASE WHEN {x} >= {lo} AND {x} <= {b1} THEN '{CLASS_LABELS[0]}' "
            f"WHEN {x} > {b1} AND {x} <= {b2} THEN '{CLASS_LABELS[1]}' "
            f"WHEN {x} > {b2} AND {x} <= {hi} THEN '{CLASS_LABELS[2]}' END)")


def cls_ord(x: str) -> str:
    return cls(x, (-10.0, 1.99, 2.01, 10.0))


def flag(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 'agreement' ELSE 'disagreement' END)"


def erfc_pos(x: str) -> str:
    t = f"({dbl(1.0)} / ({dbl(1.0)} + {dbl(AS_P)} * ({x})))"
    a1, a2, a3, a4, a5 = (dbl(v) for v in AS_A)
    poly = f"({t} * ({a1} + {t} * ({a2} + {t} * ({a3} + {t} * ({a4} + {t} * {a5})))))"
    return f"({poly} * exp(-(({x}) * ({x}))))"


def normal_sf(z: str) -> str:
    half = f"({dbl(0.5)} * {erfc_pos(f'abs({z}) / sqrt({dbl(2.0)})')})"
    return f"(CASE WHEN ({z}) >= 0 THEN {half} ELSE {dbl(1.0)} - {half} END)"


def exact_mean(x: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(38,{scale}))) AS DOUBLE) / nullif(CAST(count({x}) AS DOUBLE), 0)"


def word_tris(w: str) -> str:
    return f"list_transform(range(1, length({w}) + 1), lambda i: substr(' ' || {w} || ' ', i, 3))"


def text_tris(x: str) -> str:
    return f"flatten(list_transform({tokens(x)}, lambda w: {word_tris('w')}))"


# ---- scoring CTEs --------------------------------------------------------------------------

def scored_ctes(p: str, src: str, negation: bool = False, lex: str = "lex", modifiers: bool = False) -> dict[str, str]:
    negs = ", ".join(q(w) for w in NEGATORS)
    factor = f"CAST({NEGATION_FACTOR} AS DECIMAL(18,4))"
    tok = (f"SELECT id, rank_sentence, unnest(tk) AS word, generate_subscripts(tk, 1) AS tpos "
           f"FROM (SELECT id, rank_sentence, {tokens('sentence')} AS tk FROM {src})")
    if negation:
        tok = (f"SELECT *, coalesce(max(CASE WHEN word IN ({negs}) THEN 1 ELSE 0 END) OVER "
               f"(PARTITION BY id, rank_sentence ORDER BY tpos ROWS BETWEEN {NEGATION_REACH} PRECEDING "
               f"AND 1 PRECEDING), 0) AS negated FROM ({tok})")
        value = "l.valence"
        if modifiers:
            sign = (f"CASE WHEN word IN ({', '.join(map(q, BOOSTERS))}) THEN 1 WHEN word IN ({', '.join(map(q, DAMPERS))}) "
                    f"THEN -1 ELSE 0 END")
            over = "OVER (PARTITION BY id, rank_sentence ORDER BY tpos)"
            moved = " + ".join(f"coalesce(lag({sign}, {k}) {over}, 0) * CAST({BOOST * d} AS DECIMAL(18,6))" for k, d in enumerate(DECAY, 1))
            tok = f"SELECT *, {moved} AS moved FROM ({tok})"
            value = "(l.valence + sign(l.valence) * t.moved)"
        v = f"CASE WHEN t.negated = 1 THEN {value} * {factor} ELSE {value} END"
    else:
        v = "l.valence"
    tv = (f"SELECT t.id, t.rank_sentence, {v} AS v, l.polarity AS p, l.subjectivity AS s "
          f"FROM {p}_tok t LEFT JOIN {lex} l ON t.word = l.word")
    sgn = lambda x: f"(CASE WHEN coalesce({x}, 0) > 0 THEN 1 WHEN coalesce({x}, 0) < 0 THEN -1 ELSE 0 END)"
    parts = (f"SELECT id, rank_sentence, sum(coalesce(v, 0)) AS s_val, "
             f"sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS s_pos, "
             f"sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS s_neg, "
             f"sum(CASE WHEN v IS NULL OR v = 0 THEN 1 ELSE 0 END) AS n_neu, "
             f"sum(coalesce(p, 0)) AS s_pol, count(p) AS n_pol, sum(coalesce(s, 0)) AS s_sub, count(s) AS n_sub, "
             f"sum(CASE WHEN tone > 0 THEN 1 ELSE 0 END) AS n_up, sum(CASE WHEN tone < 0 THEN 1 ELSE 0 END) AS n_down "
             f"FROM (SELECT *, {sgn('v')} + {sgn('p')} AS tone FROM {p}_tv) GROUP BY id, rank_sentence")
    S = "CAST(coalesce(s_val, 0) AS DOUBLE)"
    tot = "CAST(coalesce(s_pos, 0) + coalesce(s_neg, 0) + coalesce(n_neu, 0) AS DOUBLE)"
    share = lambda x: (f"(CASE WHEN {tot} = 0 THEN {dbl(0.0)} ELSE "
                       f"{rhu(f'CAST(coalesce({x}, 0) AS DOUBLE) / {tot}', 3)} END)")
    mean = lambda s, n: (f"(CASE WHEN coalesce({n}, 0) = 0 THEN {dbl(0.0)} ELSE "
                         f"{rhu(f'CAST({s} AS DOUBLE) / CAST({n} AS DOUBLE)', 4)} END)")
    d = "(coalesce(n_up, 0) - coalesce(n_down, 0))"
    m = "(coalesce(n_up, 0) + coalesce(n_down, 0) + 2)"
    ordinal = (f"CAST(CASE WHEN 2 * {d} < -{m} THEN 0 WHEN 200 * {d} < -33 * {m} THEN 1 "
               f"WHEN 200 * {d} <= 33 * {m} THEN 2 WHEN 2 * {d} <= {m} THEN 3 ELSE 4 END AS INTEGER)")
    scored = (f"SELECT d.*, {ordinal} AS ordinal, "
              f"{rhu(f'{S} / sqrt({S} * {S} + {dbl(15.0)})', 4)} AS compound, "
              f"{share('n_neu')} AS neu, {share('s_neg')} AS neg, {share('s_pos')} AS pos, "
              f"{mean('s_pol', 'n_pol')} AS polarity, {mean('s_sub', 'n_sub')} AS subjectivity "
              f"FROM {src} d LEFT JOIN {p}_parts x ON d.id = x.id AND d.rank_sentence = x.rank_sentence")
    return {f"{p}_tok": tok, f"{p}_tv": tv, f"{p}_parts": parts, f"{p}_scored": scored}


DOC_SENT = (f"SELECT id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS rank_sentence, unnest(ss) AS sentence, "
            f"lang, source FROM (SELECT doc_id AS id, lang, source, "
            f"list_filter({sentences('text')}, lambda s: {not_noise('s')}) AS ss FROM documents)")
POSTS = "SELECT conv_id * 1048576 + turn AS post_id, role AS author, text FROM conversations"
POST_CLEAN = f"regexp_replace(text, {q(POST_RX)}, '', 'g')"
CONV_SENT = ("SELECT conv_id * 1048576 + turn AS id, CAST(0 AS INTEGER) AS rank_sentence, text AS sentence, "
             "role AS author FROM conversations WHERE text IS NOT NULL")
WHOLE_DOC = ("SELECT doc_id AS id, CAST(0 AS INTEGER) AS rank_sentence, text AS sentence FROM documents "
             "WHERE text IS NOT NULL")
SCORE_COLS = "id, rank_sentence, compound, polarity, ordinal"

UNITS = lambda x: f"CAST(floor(({x}) * 10000.0::DOUBLE + 0.5::DOUBLE) AS DECIMAL(14,0)) / CAST(10000 AS DECIMAL(5,0))"
TILT = "CAST(2 * g - n AS DOUBLE) / n"

CTES: dict[str, str] = {
    "lex": LEX,
    "lex_counts": (f"SELECT word, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS g, count(*) AS n FROM (SELECT quality, "
                   f"unnest(list_distinct({tokens('text')})) AS word FROM documents JOIN labels USING (doc_id) "
                   f"WHERE quality IN (0, 1)) GROUP BY word HAVING count(*) >= 3"),
    "lex_induced": (f"SELECT word, CAST({UNITS(f'{TILT} * 4.0::DOUBLE')} AS DECIMAL(18,4)) AS valence, "
                    f"CAST({UNITS(TILT)} AS DECIMAL(18,4)) AS polarity, CAST({UNITS(f'abs({TILT})')} AS DECIMAL(18,4)) AS subjectivity "
                    f"FROM lex_counts"),
    "doc_sent": DOC_SENT,
    **scored_ctes("doc", "doc_sent"),
    **scored_ctes("docn", "doc_sent", negation=True),
    **scored_ctes("docm", "doc_sent", negation=True, modifiers=True),
    **scored_ctes("doci", "doc_sent", negation=True, lex="lex_induced", modifiers=True),
    "conv_sent": CONV_SENT,
    **scored_ctes("conv", "conv_sent"),
    "whole_doc": WHOLE_DOC,
    "post_sent": (f"SELECT min(post_id) AS id, CAST(0 AS INTEGER) AS rank_sentence, text AS sentence, author FROM ("
                  f"SELECT post_id, author, {strip(POST_CLEAN)} AS text "
                  f"FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY post_id DESC) AS rn FROM ({POSTS})) "
                  f") WHERE text IS NOT NULL GROUP BY author, text"),
    **scored_ctes("post", "post_sent"),
    **scored_ctes("whole", "whole_doc"),
    "lab_scored": ("SELECT d.*, l.quality FROM doc_scored d LEFT JOIN labels l ON d.id = l.doc_id"),
    "corp": (f"SELECT {SCORE_COLS}, 'documents' AS corpus FROM doc_scored UNION ALL "
             f"SELECT {SCORE_COLS}, 'conversations' AS corpus FROM conv_scored"),
    "prof_words": (f"SELECT lang, w AS word, count(*) AS c FROM (SELECT lang, unnest({tokens('text')}) AS w "
                   f"FROM documents WHERE lang IS NOT NULL) GROUP BY lang, w"),
    "prof": (f"SELECT lang, tri, sum(c) AS n FROM (SELECT lang, c, unnest({word_tris('word')}) AS tri "
             f"FROM prof_words) GROUP BY lang, tri"),
    "consts": ("SELECT lang, ln(CAST(sum(n) AS DOUBLE) + CAST((SELECT count(DISTINCT tri) FROM prof) AS DOUBLE)) AS c "
               "FROM prof GROUP BY lang"),
    "lang_tri": (f"SELECT id, rank_sentence, unnest(tr) AS tri FROM (SELECT id, rank_sentence, "
                 f"{text_tris('sentence')} AS tr FROM doc_sent)"),
    "lang_n": f"SELECT id, rank_sentence, len({text_tris('sentence')}) AS n_tri FROM doc_sent",
    "lang_sums": (f"SELECT t.id, t.rank_sentence, p.lang, sum(ln(CAST(p.n AS DOUBLE) + {dbl(1.0)})) AS sw "
                  f"FROM lang_tri t JOIN prof p ON t.tri = p.tri GROUP BY t.id, t.rank_sentence, p.lang"),
    "lang_cand": ("SELECT n.id, n.rank_sentence, n.n_tri, c.lang, "
                  "coalesce(s.sw, 0.0) - CAST(n.n_tri AS DOUBLE) * c.c AS score "
                  "FROM lang_n n CROSS JOIN consts c LEFT JOIN lang_sums s "
                  "ON s.id = n.id AND s.rank_sentence = n.rank_sentence AND s.lang = c.lang"),
    "lang_best": (f"SELECT id, rank_sentence, CASE WHEN n_tri > 0 THEN lang ELSE {q(NO_LANGUAGE)} END AS language "
                  f"FROM (SELECT *, row_number() OVER (PARTITION BY id, rank_sentence ORDER BY score DESC, lang DESC) "
                  f"AS rn FROM lang_cand) WHERE rn = 1"),
}


def _boundary_ctes() -> dict[str, str]:
    """Counts of token types, their log-likelihood ratios, and the two kinds of boundary words."""
    ws, ln = r"[\t\n\x{0B}\f\r ]+", lambda x: f"ln(greatest({x}, 1e-300::DOUBLE))"
    bare = (f"list_transform(regexp_split_to_array(lower({strip('text')}), '{ws}'), lambda t: "
            f"regexp_replace(regexp_replace(t, {q(RX_LEAD)}, ''), {q(RX_TAIL)}, ''))")

    def binomial(k: str, n: str, p: str) -> str:
        return (f"(CASE WHEN {k} > 0 THEN {k} * {ln(p)} ELSE 0.0::DOUBLE END + "
                f"CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * {ln(f'1.0::DOUBLE - {p}')} ELSE 0.0::DOUBLE END)")

    abbreviation = f"-2.0::DOUBLE * ({binomial('np', 'n', 'np_all / n_all')} - {binomial('np', 'n', dbl(ABBREVIATION_SHARE))})"
    dots = "(length(word) - length(replace(word, '.', '')))"
    size = f"CAST(length(word) - {dots} AS DOUBLE)"
    apart = (f"-2.0::DOUBLE * ({binomial('k', 'a', 'b / n')} + {binomial('(b - k)', '(n - a)', 'b / n')} - {binomial('k', 'a', 'k / a')} "
             f"- {binomial('(b - k)', '(n - a)', '(b - k) / greatest(n - a, 1.0::DOUBLE)')})")
    return {
        "bd_raw": (f"SELECT doc, i, CASE WHEN regexp_matches(t, '[^.]\\.$') THEN regexp_replace(t, '\\.$', '') ELSE t END AS word, "
                   f"regexp_matches(t, '[^.]\\.$') AS period FROM (SELECT doc, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM "
                   f"(SELECT row_number() OVER () AS doc, {bare} AS ts FROM documents WHERE text IS NOT NULL))"),
        "bd_tok": "SELECT word, period, CASE WHEN lag(period) OVER w THEN lag(word) OVER w END AS after FROM bd_raw "
                  "WINDOW w AS (PARTITION BY doc ORDER BY i)",
        "bd_type": "SELECT word, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE period) AS DOUBLE) AS np FROM bd_tok GROUP BY word",
        "bd_all": "SELECT sum(n) AS n_all, sum(np) AS np_all FROM bd_type",
        "bd_short": (f"SELECT word, score FROM (SELECT word, {abbreviation} * exp(-{size}) * ({dots} + 1) * pow({size}, np - n) AS score "
                     f"FROM bd_type, bd_all WHERE regexp_matches(word, {q(RX_TYPE)}) AND np > 0) WHERE score >= {dbl(ABBREVIATION_SCORE)}"),
        "bd_ends": "SELECT t.word FROM bd_tok t LEFT JOIN bd_short s ON t.after = s.word WHERE t.after IS NOT NULL AND s.word IS NULL",
        "bd_start": (f"SELECT word, score FROM (SELECT word, k, a, b, n, {apart} AS score FROM (SELECT word, CAST(count(*) AS DOUBLE) AS k FROM bd_ends "
                     f"GROUP BY word) JOIN (SELECT word, n AS b FROM bd_type) USING (word), (SELECT n_all AS n FROM bd_all), "
                     f"(SELECT CAST(count(*) AS DOUBLE) AS a FROM bd_ends) WHERE regexp_matches(word, '^\\p{{L}}+$')) "
                     f"WHERE score >= {dbl(STARTER_RATIO)} AND k / a > b / n"),
        "bd_words": "SELECT word, 'abbreviation' AS kind, score FROM bd_short UNION ALL SELECT word, 'starter', score FROM bd_start",
    }


CTES.update(_boundary_ctes())
ORDER = list(CTES)


def sql(body: str, *needed: str) -> str:
    """``WITH`` the needed CTEs (and everything they depend on, in definition order) + body."""
    want: set[str] = set()

    def add(name: str) -> None:
        if name in want:
            return
        want.add(name)
        for other in ORDER:
            if other != name and re.search(rf"\b{other}\b", CTES[name]):
                add(other)

    for n in needed:
        add(n)
    if not want:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ORDER if n in want) + "\n" + body


# ---- oracle bodies -------------------------------------------------------------------------

def _html_list_rows() -> str:
    ul = q(r"(?is)<ul(?:\s[^>]*)?>(.*?)</ul\s*>")
    li = q(r"(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>")
    a = q(r"(?is)<(?:a)(?:\s[^>]*)?>(.*?)</(?:a)\s*>")
    cell = lambda x: strip(decode(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))
    return (
        f"WITH t AS (SELECT page_id, regexp_extract_all(regexp_extract_all(html, {ul}, 1)[1], {li}, 1) AS rws FROM pages), "
        f"h AS (SELECT page_id, rws, list_transform(regexp_extract_all(rws[1], {a}, 1), lambda c: {cell('c')}) AS hdr FROM t), "
        f"r AS (SELECT page_id, hdr, unnest(rws) AS rh, generate_subscripts(rws, 1) - 1 AS rw FROM h), "
        f"c AS (SELECT page_id, hdr, rw, unnest(cs) AS raw, generate_subscripts(cs, 1) - 1 AS col "
        f"FROM (SELECT page_id, hdr, rw, regexp_extract_all(rh, {a}, 1) AS cs FROM r)) "
        f"SELECT page_id, CAST(rw AS INTEGER) AS \"row\", CAST(col AS INTEGER) AS col, CAST(NULL AS VARCHAR) AS header, "
        f"{cell('raw')} AS value FROM c")


def _html_table_rows() -> str:
    cells = ("[('Customer', 'Customer & ' || CAST(o_custkey AS VARCHAR)), ('Order', CAST(o_orderkey AS VARCHAR)), "
             "('Priority', o_orderpriority), ('State', 'in of ' || o_orderstatus)]")
    return (f"SELECT page_id, rw AS \"row\", CAST(c - 1 AS INTEGER) AS col, cells[c][1] AS header, cells[c][2] AS value FROM ("
            f"SELECT o_custkey AS page_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS rw, "
            f"{cells} AS cells, unnest([1, 2, 3, 4]) AS c FROM orders WHERE o_custkey IS NOT NULL)")


def _split_learned() -> str:
    last = f"lower(regexp_replace(regexp_extract(p, '([^{WS_ASCII}]+)[{WS_ASCII}]*$', 1), {q(RX_LEAD)}, ''))"
    head = f"regexp_replace(regexp_extract(nxt, '^[{WS_ASCII}]*([^{WS_ASCII}]+)', 1), {q(RX_LEAD)}, '')"
    bare = "regexp_replace(lst, '\\.$', '')"
    starts = "regexp_extract(lower(hd), '^\\p{L}+', 0) IN (SELECT word FROM bd_words WHERE kind = 'starter')"
    short = f"(regexp_matches({bare}, '^\\p{{L}}$') OR {bare} IN (SELECT word FROM bd_words WHERE kind = 'abbreviation'))"
    ordinal = f"(regexp_matches({bare}, '^[0-9]+$') AND regexp_matches(hd, '^\\p{{Ll}}'))"
    return (f"SELECT id, CAST(row_number() OVER (PARTITION BY doc ORDER BY part) - 1 AS INTEGER) AS rank_sentence, sentence FROM ("
            f"SELECT doc, id, part, {strip('string_agg(p, chr(0) ORDER BY i)').replace('chr(0)', q(''))} AS sentence FROM ("
            f"SELECT doc, id, i, p, coalesce(sum(e) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part "
            f"FROM (SELECT doc, id, i, p, CASE WHEN NOT regexp_matches(lst, '[^.]\\.$') OR NOT (({short} AND NOT {starts}) OR {ordinal}) "
            f"THEN 1 ELSE 0 END AS e FROM (SELECT *, {last} AS lst, {head} AS hd FROM (SELECT doc, id, i, p, "
            f"coalesce(lead(p) OVER (PARTITION BY doc ORDER BY i), '') AS nxt FROM (SELECT doc, id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i "
            f"FROM (SELECT row_number() OVER () AS doc, doc_id AS id, string_split(regexp_replace(text, '{SENT_RX}', '\\0' || chr(31), 'g'), chr(31)) AS ps "
            f"FROM documents WHERE text IS NOT NULL)))))) GROUP BY doc, id, part) WHERE sentence <> '' AND {not_noise('sentence')}")


def _corpus_build() -> str:
    start = "1990 + c_custkey % 9"
    name = "regexp_replace(c_name, 'Customer#0{0,8}', 'Customer ')"
    term = (f"'March 4, ' || CAST({start} AS VARCHAR) || ' – ' || CASE WHEN c_custkey % 7 = 0 THEN 'Incumbent' "
            f"ELSE 'March 4, ' || CAST({start} + 4 AS VARCHAR) END")
    body = f"nullif({strip('text')}, '')"
    speech = f"replace(regexp_replace({body}, {q(RX_BOILER)}, ' ', 'g'), '.', '. ')"
    return (f"WITH m AS (SELECT {name} AS name, c_mktsegment AS party, {term} AS term, CASE WHEN c_custkey % 5 = 0 THEN 'Vacant' "
            f"ELSE 'Deputy ' || CAST(c_custkey % 3 AS VARCHAR) END AS deputy, CAST({start} AS INTEGER) AS \"from\", "
            f"CAST(CASE WHEN c_custkey % 7 = 0 THEN 2021 ELSE {start} + 4 END AS INTEGER) AS until FROM customer "
            f"WHERE c_custkey IS NOT NULL AND c_nationkey IS NOT NULL), "
            f"n AS (SELECT name, count(DISTINCT deputy) AS n_Deputy FROM m WHERE NOT contains(deputy, 'Vacant') GROUP BY name), "
            f"w AS (SELECT DISTINCT m.*, n.n_Deputy FROM m LEFT JOIN n USING (name)), "
            f"k AS (SELECT *, row_number() OVER (ORDER BY name, deputy, party, term) AS rn, count(*) OVER () AS total FROM w), "
            f"p AS (SELECT d.doc_id AS page_id, d.source AS title, regexp_replace(c.c_name, 'Customer#0{{0,8}}', 'Customer ') AS name, "
            f"CAST(o.o_orderdate AS DATE) AS date, {speech} AS speech FROM documents d LEFT JOIN orders o ON d.doc_id = o.o_orderkey "
            f"LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE d.doc_id IS NOT NULL) "
            f"SELECT page_id, title, p.name, CASE WHEN party = 'BUILDING' AND date < DATE '1995-01-01' THEN 'BUILDING 1' "
            f"WHEN party = 'BUILDING' AND date > DATE '1995-01-01' THEN 'BUILDING 2' ELSE party END AS party, \"from\", until, "
            f"coalesce(n_Deputy, 0) AS n_Deputy, date, coalesce(p.name, {q(DEFAULT_INFO)}) AS info, speech "
            f"FROM p LEFT JOIN (SELECT * FROM k WHERE rn <> 17 AND rn <> total) k ON p.name = k.name")


def _comparative_figures() -> str:
    share = r6("CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY figure, \"row\") AS DOUBLE)")
    one = lambda x: f"CAST(CAST({np_round(x, 1)} AS DECIMAL(4,1)) AS VARCHAR)"
    flags = " UNION ALL ".join(f"SELECT 'agreement' AS figure, '{a}_{b}' AS \"row\", {flag(x, y)} AS col FROM fl" for a, x, b, y in (
        ("compound", "cc", "polarity", "cp"), ("compound", "cc", "ordinal", "co"), ("polarity", "cp", "ordinal", "co")))
    tabs = " UNION ALL ".join(f"SELECT 'ordinal_{a}', co, {x} FROM fl WHERE co IS NOT NULL AND {x} IS NOT NULL"
                              for a, x in (("compound", "cc"), ("polarity", "cp")))
    rounded = (f"SELECT 'rounded', {one('compound')}, {one('polarity')} FROM doc_scored WHERE compound IS NOT NULL AND "
               f"polarity IS NOT NULL AND compound <> 0 AND polarity <> 0")
    body = sql(f"SELECT figure, \"row\", col, n, {share} AS share FROM (SELECT figure, \"row\", col, count(*) AS n FROM "
               f"({flags} UNION ALL {tabs} UNION ALL {rounded}) GROUP BY 1, 2, 3)", "doc_scored")
    return body.replace("\nSELECT figure", f",\nfl AS (SELECT {cls('compound')} AS cc, {cls('polarity')} AS cp, {cls_ord('ordinal')} AS co "
                                           f"FROM doc_scored)\nSELECT figure", 1)


def _links() -> str:
    base = r"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1)"
    return (f"SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://') "
            f"THEN href ELSE base || href END AS link FROM (SELECT page_id, base, unnest(hs) AS href, "
            f"generate_subscripts(hs, 1) - 1 AS pos FROM (SELECT page_id, {base} AS base, "
            f"regexp_extract_all(html, {q(HREF_RX)}, 1) AS hs FROM pages)) WHERE regexp_matches(href, '^/')")


def _fmt(x: str) -> str:
    return f"strftime({x}, '%B %-d, %Y')"


def _range_text() -> str:
    end = f"CASE WHEN o_orderstatus = 'O' THEN 'Incumbent' ELSE {_fmt('CAST(o_orderdate AS DATE) + 1000')} END"
    return f"({_fmt('o_orderdate')} || ' – ' || {end})"


def _hist() -> str:
    x = np_round("compound", 4)
    return sql(
        f"SELECT g.quality, g.bin, {r6('g.lo + g.bin * ((g.hi - g.lo) / ' + dbl(20.0) + ')')} AS bin_lo, "
        f"{r6('g.lo + (g.bin + 1) * ((g.hi - g.lo) / ' + dbl(20.0) + ')')} AS bin_hi, "
        f"CAST(coalesce(c.n, 0) AS BIGINT) AS n, {r6('coalesce(c.n, 0) * ' + dbl(100.0) + ' / g.total')} AS pct "
        f"FROM (SELECT *, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM ("
        f"  SELECT quality, count(*) AS total, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, "
        f"  CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM hv GROUP BY quality)) g "
        f"LEFT JOIN (SELECT hv.quality, e.bin, count(*) AS n FROM hv JOIN (SELECT quality, lo, (hi - lo) / {dbl(20.0)} AS w, "
        f"  CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM (SELECT quality, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, "
        f"  CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM hv GROUP BY quality)) e "
        f"  ON hv.quality = e.quality AND hv.x >= e.lo + e.bin * e.w AND (e.bin = 19 OR hv.x < e.lo + (e.bin + 1) * e.w) "
        f"  GROUP BY 1, 2) c ON g.quality = c.quality AND g.bin = c.bin",
        "lab_scored").replace("\nSELECT g.quality", f",\nhv AS (SELECT quality, {x} AS x FROM lab_scored "
                              f"WHERE quality IN (0, 1) AND compound IS NOT NULL)\nSELECT g.quality", 1)


def _crosstab_classes() -> str:
    parts = []
    for col, src in (("cat_compound", "compound"), ("cat_polarity", "polarity")):
        c = cls(src)
        o = cls_ord("ordinal")
        cnt = lambda lab: f"count(*) FILTER (WHERE cc = '{lab}')"
        tot = "CAST(count(*) AS DOUBLE)"
        cols = ", ".join(f"{r6(f'CAST({cnt(lab)} AS DOUBLE) / {tot}')} AS {lab}" for lab in CLASS_LABELS)
        pcts = ", ".join(f"round_even(CAST({cnt(lab)} AS DOUBLE) / {tot} * 100, 0) AS pct_{lab}" for lab in CLASS_LABELS)
        parts.append(f"SELECT '{col}' AS col_class, co AS cat_ordinal, {cols}, {pcts} FROM "
                     f"(SELECT {o} AS co, {c} AS cc FROM doc_scored) WHERE co IS NOT NULL AND cc IS NOT NULL GROUP BY co")
    return sql(" UNION ALL ".join(parts), "doc_scored")


def _corr_info() -> str:
    parts = []
    for name, src in (("documents", "doc_scored"), ("conversations", "conv_scored")):
        pair = "compound IS NOT NULL AND polarity IS NOT NULL AND compound <> 0 AND polarity <> 0"
        xa, ya = f"CASE WHEN {pair} THEN compound END", f"CASE WHEN {pair} THEN polarity END"
        dis = f"{flag(cls('compound'), cls('polarity'))} = 'disagreement'"
        one = "(compound = 0 OR polarity = 0)"
        parts.append(
            f"SELECT '{name}' AS corpus, "
            f"{r6(f'covar_samp({xa}, {ya}) / nullif(stddev_samp({xa}) * stddev_samp({ya}), 0)')} AS r, "
            f"{r6(f'CAST(count(*) FILTER (WHERE {dis} AND coalesce({one}, false)) AS DOUBLE) / nullif(CAST(count(*) FILTER (WHERE {dis}) AS DOUBLE), 0)')} "
            f"AS share_one_neutral FROM {src}")
    return sql(" UNION ALL ".join(parts), "doc_scored", "conv_scored")


def _mann_whitney() -> str:
    n1, n2 = "CAST(n1 AS DOUBLE)", "CAST(n2 AS DOUBLE)"
    n = f"({n1} + {n2})"
    u1 = f"(r1 - {n1} * ({n1} + 1) / 2)"
    mu = f"({n1} * {n2} / 2)"
    sigma = f"sqrt({n1} * {n2} / 12 * (({n} + 1) - CAST(ties AS DOUBLE) / ({n} * ({n} - 1))))"
    dev = f"({u1} - {mu})"
    z2 = f"((abs({dev}) - 0.5) / nullif({sigma}, 0))"
    zg = f"(({dev} - 0.5) / nullif({sigma}, 0))"
    zl = f"((-{dev} - 0.5) / nullif({sigma}, 0))"
    return sql(
        f"SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {r6('r1')} AS r1, {r6(u1)} AS u1, "
        f"{r6(f'{n1} * {n2} - {u1}')} AS u2, {r6(f'least({u1}, {n1} * {n2} - {u1})')} AS u, "
        f"CAST(ties AS DOUBLE) AS ties, {r6(z2)} AS z, {r6(f'least({dbl(1.0)}, {dbl(2.0)} * {normal_sf(z2)})')} AS p_two_sided, "
        f"{r6(normal_sf(zg))} AS p_greater, {r6(normal_sf(zl))} AS p_less FROM ("
        f"SELECT sum(na) AS n1, sum(t) - sum(na) AS n2, sum(na * (cum - (t - 1) / {dbl(2.0)})) AS r1, "
        f"sum(t * t * t - t) AS ties FROM (SELECT v, na, t, sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED "
        f"PRECEDING AND CURRENT ROW) AS cum FROM (SELECT compound AS v, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) "
        f"AS na, count(*) AS t FROM lab_scored WHERE compound IS NOT NULL AND quality IN (1, 0) GROUP BY compound)))",
        "lab_scored")


def _mann_whitney_exact() -> str:
    """By enumeration: every way to choose the first group's ranks, as bits of a number."""
    at_least = lambda u: f"CAST(count(*) FILTER (WHERE w >= {u}) AS DOUBLE) / CAST(count(*) AS DOUBLE)"
    return ("WITH b AS (SELECT n_regionkey AS g, avg(c_acctbal) AS x FROM nation JOIN customer ON n_nationkey = c_nationkey "
            "WHERE n_regionkey IN (0, 1) GROUP BY n_nationkey, n_regionkey), "
            "r AS (SELECT g, row_number() OVER (ORDER BY x) AS rk FROM b), "
            "s AS (SELECT count(*) FILTER (WHERE g = 0) AS n1, count(*) FILTER (WHERE g = 1) AS n2, "
            "CAST(sum(rk) FILTER (WHERE g = 0) AS DOUBLE) AS r1 FROM r), "
            "u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u1, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0::DOUBLE) AS u2 FROM s), "
            "e AS (SELECT i, bit_count(i) AS k, list_sum(list_transform(range(10), lambda j: ((i >> j) & 1) * (j + 1))) AS rs "
            "FROM range(1024) t(i)), "
            "c AS (SELECT u.*, rs - n1 * (n1 + 1) / 2.0::DOUBLE AS w FROM e, u WHERE k = n1) "
            f"SELECT n1, n2, u1, u2, 'exact' AS method, {r6(f'least(1.0::DOUBLE, 2.0::DOUBLE * {at_least('greatest(u1, u2)')})')} AS p_two_sided, "
            f"{r6(at_least('u1'))} AS p_greater, {r6(at_least('u2'))} AS p_less FROM c GROUP BY n1, n2, u1, u2")


def _kde() -> str:
    u = "((g.x - w.v) / g.h)"
    return sql(
        f"SELECT g.corpus, CAST(g.i AS INTEGER) AS i, {r6('g.x')} AS x, "
        f"{r6(f'sum(w.w * exp({dbl(-0.5)} * {u} * {u})) / (g.n * g.h * sqrt(2 * pi()))')} AS density "
        f"FROM (SELECT corpus, compound AS v, count(*) AS w FROM corp WHERE compound IS NOT NULL GROUP BY 1, 2) w "
        f"JOIN (SELECT corpus, n, h, i, (mn - {dbl(3.0)} * h) + i * ((mx - mn + {dbl(6.0)} * h) / {dbl(99.0)}) AS x "
        f"FROM (SELECT *, sd * pow(CAST(n AS DOUBLE), {dbl(-0.2)}) AS h FROM (SELECT corpus, count(*) AS n, "
        f"stddev_samp(compound) AS sd, min(compound) AS mn, max(compound) AS mx FROM corp "
        f"WHERE compound IS NOT NULL GROUP BY corpus)) s, range(0, 100) t(i) WHERE h > 0) g ON w.corpus = g.corpus "
        f"GROUP BY g.corpus, g.i, g.x, g.n, g.h",
        "corp")


def _rolling(select_extra: str) -> str:
    w5 = "OVER (PARTITION BY id ORDER BY rank_sentence ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(polarity) {w5} = 5 THEN avg(polarity) {w5} END"


INFO_AD_FLAT = f"regexp_replace({element_text('html', 'div', 'ad')}, '\\n', ' ', 'g')"
TEXT_CLEAN = f"replace(regexp_replace(text, {q(RX_BOILER)}, ' ', 'g'), '.', '. ')"


def share_of(label: str) -> str:
    return f"CAST(count(*) FILTER (WHERE t = {q(label)}) AS DOUBLE) / CAST(count(*) AS DOUBLE)"


ORACLES: dict[str, str] = {
    "lang_summary": sql(
        f"SELECT lang, count(*) AS n_sentences, {r6(exact_mean('compound'))} AS mean_compound, "
        f"{r6(exact_mean('polarity'))} AS mean_polarity, {r6('median(compound)')} AS median_compound "
        f"FROM doc_scored WHERE lang IS NOT NULL GROUP BY lang", "doc_scored"),
    "csv_roundtrip": "SELECT doc_id, lang, source, text FROM documents",
    "page_title": f"SELECT page_id, {element_text('html', 'title')} AS title FROM pages",
    "page_links": _links(),
    "links_with_seeds": (f"SELECT page_id, link FROM ({_links()}) UNION ALL SELECT CAST(NULL AS BIGINT), "
                         f"'http://seed.example.com/first' UNION ALL SELECT CAST(NULL AS BIGINT), 'http://seed.example.com/second'"),
    "page_body": (f"SELECT page_id, coalesce(nullif({strip(element_text('html', 'div', 'transcript-inner'))}, ''), "
                  f"nullif({strip(element_text('html', 'article'))}, '')) AS body FROM pages"),
    "page_body_parsed": (f"SELECT page_id, coalesce(nullif({strip(element_text('html', 'div', 'transcript-inner'))}, ''), "
                         f"nullif({strip(element_text('html', 'article'))}, '')) AS body FROM pages"),
    "page_info_default": (f"SELECT page_id, {default_if_blank(element_text('html', 'div', 'ad'), DEFAULT_INFO)} AS info_ad, "
                          f"{default_if_blank(element_text('html', 'div', 'about-sidebar--intro'), DEFAULT_INFO)} "
                          f"AS info_sidebar FROM pages"),
    "page_extract": (
        f"SELECT page_id, url, {element_text('html', 'h1')} AS title, {element_text('html', 'title')} AS doc_title, "
        f"replace(regexp_replace(coalesce(nullif({strip(element_text('html', 'div', 'transcript-inner'))}, ''), "
        f"nullif({strip(element_text('html', 'article'))}, '')), {q(RX_BOILER)}, ' ', 'g'), '.', '. ') AS speech, "
        f"{default_if_blank(INFO_AD_FLAT, DEFAULT_INFO)} AS info, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS DATE) AS date, "
        f"CAST(len(regexp_extract_all(html, {q(HREF_RX)}, 1)) AS INTEGER) AS n_links FROM pages"),
    "html_table_rows": _html_table_rows(),
    "html_list_rows": _html_list_rows(),
    "meta_projection": "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer",
    "clean_column_names": 'SELECT c_custkey AS "Key", c_name AS "Name", c_mktsegment AS "Segment" FROM customer',
    "recode_conditional": (
        "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1998-01-01' "
        "THEN '1-URGENT 1' WHEN o_orderpriority = '1-URGENT' AND o_orderdate > TIMESTAMP '1998-01-01' "
        "THEN '1-URGENT 2' ELSE o_orderpriority END AS o_orderpriority FROM orders"),
    "agreement_flags": sql(
        f"SELECT id, rank_sentence, cc AS cat_compound, cp AS cat_polarity, co AS cat_ordinal, "
        f"{flag('cc', 'cp')} AS flag_compound_polarity, {flag('cc', 'co')} AS flag_compound_ordinal, "
        f"{flag('cp', 'co')} AS flag_polarity_ordinal FROM (SELECT id, rank_sentence, {cls('compound')} AS cc, "
        f"{cls('polarity')} AS cp, {cls_ord('ordinal')} AS co FROM doc_scored)", "doc_scored"),
    "corpus_union": sql("SELECT id, rank_sentence, compound, polarity, ordinal, corpus FROM corp", "corp"),
    "year_of": (f"SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, "
                f"TRY_CAST(nullif(regexp_extract({_fmt('o_orderdate')}, '[0-9]{{4}}', 0), '') AS INTEGER) AS year_text, "
                f"TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS priority_num FROM orders"),
    "fill_missing": ("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d "
                     "LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "speech_progress": sql(
        "SELECT id, rank_sentence, CAST(row_number() OVER (PARTITION BY id ORDER BY rank_sentence) AS INTEGER) AS cumcount, "
        "CAST(row_number() OVER (PARTITION BY id ORDER BY rank_sentence) AS DOUBLE) / "
        "CAST(count(*) OVER (PARTITION BY id) AS DOUBLE) AS percentage FROM doc_sent", "doc_sent"),
    "filter_contains": "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red')",
    "filter_regex_any": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'widget|gear')",
    "filter_equals": "SELECT doc_id, lang FROM documents WHERE lang = 'en'",
    "filter_not_contains": "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'small')",
    "filter_threshold": ("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders "
                         "WHERE year(o_orderdate) > 1999"),
    "hist_by_group": _hist(),
    "nonzero_pairs": sql("SELECT id, rank_sentence, compound, polarity FROM doc_scored "
                         "WHERE coalesce(compound <> 0, true) AND coalesce(polarity <> 0, true)", "doc_scored"),
    "sentence_filter": (f"SELECT id, CAST(pos AS INTEGER) AS pos, sentence FROM (SELECT doc_id AS id, "
                        f"unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM (SELECT doc_id, "
                        f"{sentences('text')} AS ss FROM documents)) WHERE {not_noise('sentence')}"),
    "drop_position": ("SELECT n_nationkey, n_name FROM (SELECT n_nationkey, n_name, row_number() OVER "
                      "(ORDER BY n_nationkey) AS rn, count(*) OVER () AS total FROM nation) WHERE rn <> 17 AND rn <> total"),
    "attach_metadata": sql("SELECT s.id, s.rank_sentence, d.lang, d.source, d.n_chars FROM doc_sent s "
                           "LEFT JOIN documents d ON s.id = d.doc_id", "doc_sent"),
    "distinct_count_join": (
        "SELECT o.o_orderkey, o.o_custkey, c.n_priorities FROM orders o LEFT JOIN (SELECT o_custkey, "
        "count(DISTINCT o_orderpriority) AS n_priorities FROM orders WHERE NOT contains(o_orderstatus, 'P') "
        "AND o_custkey IS NOT NULL GROUP BY o_custkey) c ON o.o_custkey = c.o_custkey"),
    "enrich_left_join": ("SELECT c.c_custkey, c.c_name, n.n_name FROM customer c "
                         "LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"),
    "group_share": sql(
        f"SELECT c.ordinal, c.corpus, c.n, g.groupsize, {r6('CAST(c.n AS DOUBLE) / CAST(g.groupsize AS DOUBLE)')} AS perc "
        f"FROM (SELECT ordinal, corpus, count(*) AS n FROM corp WHERE ordinal IS NOT NULL AND corpus IS NOT NULL "
        f"GROUP BY 1, 2) c LEFT JOIN (SELECT corpus, count(*) AS groupsize FROM corp WHERE corpus IS NOT NULL "
        f"GROUP BY 1) g ON c.corpus = g.corpus", "corp"),
    "score_compound": sql("SELECT id, rank_sentence, compound FROM doc_scored", "doc_scored"),
    "distinct_rows": "SELECT DISTINCT lang, source FROM documents",
    "dedupe_text": (f"SELECT min(post_id) AS post_id, author, text FROM (SELECT post_id, author, "
                    f"{strip(POST_CLEAN)} AS text "
                    f"FROM ({POSTS})) GROUP BY author, text"),
    "panel_index": ("SELECT user_id, rn - 1 AS panel, CAST(floor((rn - 1) / 3) AS INTEGER) AS panel_row, "
                    "CAST((rn - 1) % 3 AS INTEGER) AS panel_col, concat_ws(' - ', 'user ' || CAST(user_id AS VARCHAR), "
                    "CAST(year(first_ts) AS VARCHAR)) AS title FROM (SELECT user_id, first_ts, row_number() OVER "
                    "(ORDER BY first_ts, user_id) AS rn FROM (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id))"),
    "panel_count": "SELECT count(DISTINCT user_id) AS n_groups FROM events",
    "strip_footnotes": (f"SELECT doc_id, regexp_replace(lang, {q(RX_FOOTNOTE)}, '', 'g') AS lang, "
                        f"regexp_replace(text, {q(RX_FOOTNOTE)}, '', 'g') AS text FROM documents"),
    "normalise_names": ("SELECT n_nationkey, regexp_replace(regexp_replace(n_name, 'NATION_', 'Nation ', 'g'), "
                        "'Nation 0', 'Nation zero', 'g') AS n_name, n_regionkey FROM nation"),
    "clean_text": (f"SELECT doc_id, {strip(TEXT_CLEAN)} "
                   f"AS text FROM documents"),
    "clean_post": (f"SELECT post_id, author, {strip(POST_CLEAN)} "
                   f"AS text FROM ({POSTS})"),
    "parse_range": (f"SELECT o_orderkey, range_text, CAST(year({parse_date(split_part('range_text', '–', 1))}) AS INTEGER) AS from_year, "
                    f"CAST(CASE WHEN {strip(split_part('range_text', '–', 2))} = 'Incumbent' THEN 2021 "
                    f"ELSE year({parse_date(split_part('range_text', '–', 2))}) END AS INTEGER) AS until_year "
                    f"FROM (SELECT o_orderkey, {_range_text()} AS range_text FROM orders)"),
    "parse_date": (f"SELECT o_orderkey, date_text, {parse_date('date_text')} AS parsed FROM (SELECT o_orderkey, "
                   f"CASE WHEN o_orderkey % 50 = 0 THEN 'junk' WHEN o_orderkey % 4 = 0 THEN {_fmt('o_orderdate')} "
                   f"WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') "
                   f"WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') "
                   f"ELSE strftime(o_orderdate, '%Y') END AS date_text FROM orders)"),
    "parse_date_free": ("SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 9 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders "
                        "WHERE o_orderdate IS NOT NULL"),
    "median_raw": ("SELECT event_type, median(value) AS median, count(*) AS n FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL "
                   "AND NOT isnan(value) GROUP BY event_type"),
    "mann_whitney_exact": _mann_whitney_exact(),
    "crosstab_rounded": sql(
        f"SELECT compound_round, polarity_round, n, "
        f"{r6('CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY compound_round) AS DOUBLE)')} AS share FROM "
        f"(SELECT {np_round('compound', 1)} AS compound_round, {np_round('polarity', 1)} AS polarity_round, "
        f"count(*) AS n FROM doc_scored WHERE compound IS NOT NULL AND polarity IS NOT NULL AND compound <> 0 "
        f"AND polarity <> 0 GROUP BY 1, 2)", "doc_scored"),
    "tokenize_words": f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS w FROM documents) GROUP BY w",
    "sentence_split": sql("SELECT id, rank_sentence, sentence FROM doc_sent", "doc_sent"),
    "boundary_statistics": sql(f"SELECT word, kind, {r6('score')} AS score FROM bd_words", "bd_words"),
    "sentence_split_learned": sql(_split_learned(), "bd_words"),
    "score_documents": sql("SELECT id, ordinal, compound, neu, neg, pos, polarity, subjectivity FROM whole_scored",
                           "whole_scored"),
    "score_shares": sql("SELECT id, rank_sentence, neg, neu, pos FROM doc_scored", "doc_scored"),
    "score_negation": sql("SELECT id, rank_sentence, compound FROM docn_scored", "docn_scored"),
    "score_modifiers": sql("SELECT id, rank_sentence, compound, neg, neu, pos FROM docm_scored", "docm_scored"),
    "lexicon_induced": sql("SELECT word, CAST(valence AS DOUBLE) AS valence, CAST(polarity AS DOUBLE) AS polarity, "
                           "CAST(subjectivity AS DOUBLE) AS subjectivity FROM lex_induced", "lex_induced"),
    "score_large_lexicon": sql("SELECT id, rank_sentence, ordinal, compound, neg, neu, pos, polarity, subjectivity "
                               "FROM doci_scored", "doci_scored"),
    "score_polarity": sql("SELECT id, rank_sentence, polarity, subjectivity FROM doc_scored", "doc_scored"),
    "score_ordinal": sql("SELECT id, rank_sentence, ordinal FROM doc_scored", "doc_scored"),
    "language_id": sql("SELECT id, rank_sentence, language FROM lang_best", "lang_best"),
    "sentiment_table": sql(
        "SELECT d.id, d.rank_sentence, d.sentence, d.ordinal, d.compound, d.neu, d.neg, d.pos, d.polarity, "
        "d.subjectivity, b.language, d.lang, d.source FROM doc_scored d LEFT JOIN lang_best b "
        "ON d.id = b.id AND d.rank_sentence = b.rank_sentence", "doc_scored", "lang_best"),
    "posts_scored": sql("SELECT id, author, sentence, compound, polarity, ordinal FROM post_scored", "post_scored"),
    "tokens_to_map": (r"SELECT post_id, CAST(idx AS INTEGER) AS index, w AS word, lower(w) AS lemma FROM "
                      r"(SELECT post_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS idx FROM "
                      rf"(SELECT post_id, regexp_extract_all(text, '\p{{L}}+', 0) AS ws FROM ({POSTS})))"),
    "polarity_class": sql(f"SELECT id, rank_sentence, {cls('compound')} AS cat_compound, {cls('polarity')} AS cat_polarity, "
                          f"{cls_ord('ordinal')} AS cat_ordinal FROM doc_scored", "doc_scored"),
    "disagreement_types": sql(
        f"SELECT disagreement, {r6(share_of('one_neutral'))} AS one_neutral, "
        f"{r6(share_of('other'))} AS other "
        f"FROM (SELECT {flag(cls('compound'), cls('polarity'))} AS disagreement, CASE WHEN compound = 0 OR polarity = 0 "
        f"THEN 'one_neutral' ELSE 'other' END AS t FROM doc_scored) GROUP BY disagreement", "doc_scored"),
    "agreement_pct": sql(
        f"SELECT pair, flag, count(*) AS n, {r6('CAST(count(*) AS DOUBLE) * ' + dbl(100.0) + ' / CAST(sum(count(*)) OVER (PARTITION BY pair) AS DOUBLE)')} AS pct "
        f"FROM (SELECT 'compound_polarity' AS pair, {flag('cc', 'cp')} AS flag FROM fl UNION ALL "
        f"SELECT 'compound_ordinal', {flag('cc', 'co')} FROM fl UNION ALL SELECT 'polarity_ordinal', {flag('cp', 'co')} FROM fl) "
        f"GROUP BY pair, flag", "doc_scored").replace(
            "\nSELECT pair", f",\nfl AS (SELECT {cls('compound')} AS cc, {cls('polarity')} AS cp, {cls_ord('ordinal')} AS co "
                             f"FROM doc_scored)\nSELECT pair", 1),
    "crosstab_classes": _crosstab_classes(),
    "corr_info": _corr_info(),
    "corr_matrix": sql(
        f"SELECT var1, var2, {r6('r')} AS r FROM (SELECT 'compound' AS var1, 'compound' AS var2, 1.0::DOUBLE AS r "
        f"UNION ALL SELECT 'compound', 'polarity', (SELECT covar_samp(compound, polarity) / "
        f"nullif(stddev_samp(compound) * stddev_samp(polarity), 0) FROM nz) UNION ALL SELECT 'polarity', 'compound', "
        f"(SELECT covar_samp(polarity, compound) / nullif(stddev_samp(polarity) * stddev_samp(compound), 0) FROM nz) "
        f"UNION ALL SELECT 'polarity', 'polarity', 1.0::DOUBLE)", "doc_scored").replace(
            "\nSELECT var1", ",\nnz AS (SELECT compound, polarity FROM doc_scored WHERE compound IS NOT NULL AND "
                             "polarity IS NOT NULL AND compound <> 0 AND polarity <> 0)\nSELECT var1", 1),
    "evolution_band": sql(
        f"SELECT id, lang, {r6('mean')} AS mean, {r6('std')} AS std, {r6('mean - std')} AS lower, "
        f"{r6('mean + std')} AS upper FROM (SELECT id, arg_min(lang, rank_sentence) AS lang, avg(ordinal) AS mean, "
        f"stddev_samp(ordinal) AS std FROM doc_scored GROUP BY id)", "doc_scored"),
    "mean_over_time": (f"SELECT user_id, {r6('avg(value)')} AS mean, arg_min(event_type, ts) AS event_type, "
                       f"CAST(year(min(ts)) AS INTEGER) AS year FROM events WHERE user_id IS NOT NULL GROUP BY user_id"),
    "scorer_means": sql(f"SELECT id, {r6(exact_mean('compound'))} AS mean_compound, {r6(exact_mean('polarity'))} AS mean_polarity, "
                        f"{r6('avg(ordinal)')} AS mean_ordinal FROM doc_scored GROUP BY id", "doc_scored"),
    "ordinal_share": sql(
        f"SELECT quality, ordinal, count(*) AS n, "
        f"{r6('CAST(count(*) AS DOUBLE) * ' + dbl(100.0) + ' / CAST(sum(count(*)) OVER (PARTITION BY quality) AS DOUBLE)')} AS pct "
        f"FROM lab_scored WHERE ordinal IS NOT NULL AND quality IS NOT NULL GROUP BY quality, ordinal", "lab_scored"),
    "kde_by_corpus": _kde(),
    "median_by_group": sql(f"SELECT quality, {r6('median(compound)')} AS median, count(*) AS n FROM lab_scored "
                           f"WHERE quality IS NOT NULL AND compound IS NOT NULL GROUP BY quality", "lab_scored"),
    "mann_whitney": _mann_whitney(),
    "series_by_id": sql(
        f"SELECT id, {r6('CAST(row_number() OVER (PARTITION BY id ORDER BY rank_sentence) AS DOUBLE) / CAST(count(*) OVER (PARTITION BY id) AS DOUBLE)')} AS x, "
        f"{r6('polarity')} AS y, {r6(_rolling(''))} AS ma FROM doc_scored", "doc_scored"),
    "rolling_mean5": sql(f"SELECT id, rank_sentence, {r6('polarity')} AS polarity, {r6(_rolling(''))} AS polarity_ma5 "
                         f"FROM doc_scored", "doc_scored"),
    "top_n_per_group": (f"SELECT post_id, author, CAST(rn AS INTEGER) AS rank FROM (SELECT post_id, author, "
                        f"row_number() OVER (PARTITION BY author ORDER BY post_id DESC) AS rn FROM ({POSTS})) WHERE rn <= 100"),
    "stream_scores": sql("SELECT id, rank_sentence, lang, compound, polarity, ordinal FROM doc_scored", "doc_scored"),
    "sort_sentences": sql("SELECT l.quality, s.id, s.rank_sentence FROM doc_sent s LEFT JOIN labels l ON s.id = l.doc_id "
                          "ORDER BY l.quality NULLS LAST, s.id, s.rank_sentence", "doc_sent"),
    "evolution_by_date": sql(
        f"SELECT id, lang, date, {r6('mean')} AS mean, {r6('std')} AS std, {r6('mean - std')} AS lower, "
        f"{r6('mean + std')} AS upper FROM (SELECT id, arg_min(lang, rank_sentence) AS lang, min(CAST(o_orderdate AS DATE)) AS date, "
        f"avg(ordinal) AS mean, stddev_samp(ordinal) AS std FROM doc_scored LEFT JOIN orders ON id = o_orderkey GROUP BY id)", "doc_scored"),
    "comparative_figures": _comparative_figures(),
    "corpus_build": _corpus_build(),
}

__all__ = ["ORACLES", "CTES", "sql", "RX_TITLES"]
