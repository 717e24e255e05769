"""Shared SQL fragments for the DuckDB oracle.

The oracle is written independently of the Spark code: plain SQL over the
pre-registered tables, with DuckDB's own functions (``unnest``,
``generate_subscripts``, list lambdas, window functions).
"""

from __future__ import annotations

from ..functions.expand import ABBREVIATIONS, COMBINING_MARKS

# Python whitespace class as an RE2 character class.
WS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def norm(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def chars(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, '') END"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def expand_literals(x: str) -> str:
    seen, expr = set(), x
    for k, v in ABBREVIATIONS:
        if k in seen:
            continue
        seen.add(k)
        expr = f"replace({expr}, {sql_str(k)}, {sql_str(v)})"
    return expr


def strip_marks(x: str) -> str:
    return f"translate({x}, {sql_str(COMBINING_MARKS)}, '')"


DOC_LINES = """
doc_lines AS (
  SELECT page_id, lang, source, unnest(l) AS text,
         CAST(unnest(range(0, len(l))) AS BIGINT) AS line_number
  FROM (SELECT doc_id AS page_id, lang, source, regexp_extract_all(text, '.{1,48}') AS l FROM documents)
)"""

PAIRS = DOC_LINES + """,
pairs AS (
  SELECT page_id, line_number, lang, source,
         CAST(page_id AS VARCHAR) || '_line_' || CAST(line_number AS VARCHAR) AS line_id,
         text,
         CASE WHEN line_number % 4 = 0 THEN text
              WHEN line_number % 7 = 0 THEN replace(replace(translate(text, 'uc', 'ne'), 'm', 'rn'), ' a', ' ')
              ELSE replace(replace(replace(translate(text, 'uc', 'ne'), 'm', 'rn'), 'th', 'tb'), 'li', 'h') END
           AS ocr_prediction
  FROM doc_lines
)"""


def with_pairs(body: str, *more_ctes: str) -> str:
    ctes = ",\n".join([PAIRS.strip()] + [c.strip() for c in more_ctes])
    return f"WITH {ctes}\n{body}"


# Token pattern of the lexicon corrector: word runs and whitespace runs.
TOKENS_RE = "[^" + WS[1:-1] + "]+|" + WS + "+"


def tok13a(x: str) -> str:
    s = f"regexp_replace({x}, '{WS}+$', '')"
    for a, b in [("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"),
                 ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")]:
        s = f"replace({s}, {a}, {b})"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in [(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                     (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")]:
        s = f"regexp_replace({s}, {sql_str(pat)}, {sql_str(rep)}, 'g')"
    return words(s)


def bleu_ctes(src: str, key: str, hyp: str, ref: str, name: str = "bleu") -> list[str]:
    """CTEs computing sentence BLEU per ``key`` of table ``src`` (exploded n-gram counts).

    Produces CTE ``{name}`` with columns (key..., bleu_score).
    """
    k = ", ".join(f"{c}" for c in key.split(","))
    kk = ", ".join(f"t.{c.strip()}" for c in key.split(","))
    kj = " AND ".join(f"s.{c.strip()} = g.{c.strip()}" for c in key.split(","))
    ctes = [
        f"{name}_tok AS (SELECT {k}, {tok13a(f'coalesce({hyp}, {chr(39)}{chr(39)})')} AS ht, "
        f"{tok13a(f'coalesce({ref}, {chr(39)}{chr(39)})')} AS rt FROM {src})",
        f"""{name}_grams AS (
  SELECT {kk}, n.n AS n, 'h' AS side, array_to_string(list_slice(t.ht, i.i, i.i + n.n - 1), ' ') AS g
  FROM {name}_tok t, (SELECT unnest(range(1, 5)) AS n) n, LATERAL (SELECT unnest(range(1, len(t.ht) - n.n + 2)) AS i) i
  UNION ALL
  SELECT {kk}, n.n AS n, 'r' AS side, array_to_string(list_slice(t.rt, i.i, i.i + n.n - 1), ' ') AS g
  FROM {name}_tok t, (SELECT unnest(range(1, 5)) AS n) n, LATERAL (SELECT unnest(range(1, len(t.rt) - n.n + 2)) AS i) i)""",
        f"""{name}_match AS (
  SELECT {k}, n, sum(least(ch, cr)) AS c FROM (
    SELECT {k}, n, g, count(*) FILTER (WHERE side = 'h') AS ch, count(*) FILTER (WHERE side = 'r') AS cr
    FROM {name}_grams GROUP BY ALL) GROUP BY ALL)""",
        f"""{name}_stats AS (
  SELECT {", ".join("s." + c.strip() for c in key.split(","))}, len(s.ht) AS lh, len(s.rt) AS lr,
         {", ".join(f"coalesce(sum(g.c) FILTER (WHERE g.n = {n}), 0) AS c{n}" for n in range(1, 5))},
         {", ".join(f"greatest(len(s.ht) - {n - 1}, 0) AS t{n}" for n in range(1, 5))}
  FROM {name}_tok s LEFT JOIN {name}_match g ON {kj}
  GROUP BY ALL)""",
    ]
    z = []
    terms = []
    for n in range(1, 5):
        z.append(f"(CASE WHEN c{n} = 0 THEN 1 ELSE 0 END)")
        zn = " + ".join(z)
        terms.append(f"(CASE WHEN t{n} > 0 THEN (CASE WHEN c{n} > 0 THEN ln(CAST(c{n} AS DOUBLE) / t{n}) "
                     f"ELSE -(({zn}) * ln(2.0) + ln(CAST(t{n} AS DOUBLE))) END) ELSE 0.0 END)")
    score = (f"CASE WHEN c1 + c2 + c3 + c4 = 0 THEN 0.0 ELSE "
             f"(CASE WHEN lh >= lr THEN 1.0 ELSE exp(1.0 - CAST(lr AS DOUBLE) / lh) END) * "
             f"exp(({' + '.join(terms)}) / least(4, lh)) END")
    ctes.append(f"{name} AS (SELECT {k}, {score} AS bleu_score FROM {name}_stats)")
    return ctes


def lev(a: str, b: str) -> str:
    """Code-point Levenshtein in DuckDB (its ``levenshtein`` counts bytes).

    ASCII pairs use ``levenshtein`` directly.  Otherwise the pair's distinct
    non-ASCII characters are translated to single control bytes U+0001..U+001F
    (absent from the fixture lines), which keeps the distance exact; pairs with
    more than 31 distinct non-ASCII characters code every character by its
    position in the pair's character set instead (exact below 128).
    """
    ca, cb = chars(a), chars(b)
    v = f"list_distinct(list_concat({ca}, {cb}))"
    na = f"list_distinct(list_filter(string_split({a} || {b}, ''), lambda ch: ord(ch) > 127))"
    src = f"array_to_string({na}, '')"
    dst = f"array_to_string(list_transform(range(1, len({na}) + 1), lambda i: chr(CAST(i AS INTEGER))), '')"

    def enc(c):
        return f"array_to_string(list_transform({c}, lambda ch: chr(CAST(list_position({v}, ch) AS INTEGER))), '')"
    return (f"(CASE WHEN {a} = {b} THEN 0 WHEN NOT regexp_matches({a} || {b}, '[^\\x00-\\x7f]') "
            f"THEN levenshtein({a}, {b}) "
            f"WHEN len({na}) <= 31 THEN levenshtein(translate({a}, {src}, {dst}), translate({b}, {src}, {dst})) "
            f"ELSE levenshtein({enc(ca)}, {enc(cb)}) END)")
