"""DuckDB SQL for the registered queries of this subpackage, written apart from their code."""

from __future__ import annotations

from turnwise.llm.decontaminate import RUN, SHARE, UNIT_WORDS, WINDOW
from turnwise.llm.licenses import COVERAGE, FUNCTION_WORDS, SHORT_GRAMS, SLACK, STRETCH, TEMPLATES
from turnwise.llm.quality import STOP_WORDS
from turnwise.llm.urls import LIMIT, SOFT, SOFT_TERMS, STRICT

# Kind, pattern, number of the group that has to be long enough, least length.
_SECRET_KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("github", "gh[opsu]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    ("stripe", "[rs]k_(live|test)_[A-Za-z0-9]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_matches(number: int) -> str:
    """Matches of one kind with their places: the lengths of what stands between them, added up."""
    kind, pattern, group, least = _SECRET_KINDS[number]
    return f"""
    SELECT row_id, {number} AS number, {_quoted(kind)} AS kind, start, start + length(found) AS stop
    FROM (
      SELECT row_id, n, found, part,
        sum(length(before) + length(found)) OVER (PARTITION BY row_id ORDER BY n) - length(found) AS start
      FROM (
        SELECT row_id, unnest(generate_series(1, len(founds))) AS n, unnest(founds) AS found, unnest(parts) AS part,
          unnest(befores[1:len(founds)]) AS before
        FROM (
          SELECT row_id, regexp_extract_all(text, {_quoted(pattern)}) AS founds,
            regexp_extract_all(text, {_quoted(pattern)}, {group}) AS parts,
            regexp_split_to_array(text, {_quoted(pattern)}) AS befores
          FROM docs WHERE regexp_matches(text, {_quoted(pattern)}))))
    WHERE length(part) >= {least}"""


SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_secret_matches(n) for n in range(len(_SECRET_KINDS)))}),
joined AS (
  SELECT row_id,
    count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access,
    count(*) FILTER (number = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (number < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans
  FROM found GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (row_id)
"""


_STOP_WORDS = ", ".join(_quoted(w) for w in sorted(set(STOP_WORDS)))
_CAPITAL, _LETTER = r"'[^\p{Lu}]+', '', 'g'", r"'[^\p{L}]+', '', 'g'"
QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS list
  FROM documents),
words AS (
  SELECT row_id, unnest(list) AS word, unnest(generate_series(1, len(list))) AS place FROM docs),
windows AS (
  SELECT row_id, place, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c
  FROM words WINDOW w AS (PARTITION BY row_id ORDER BY place)),
twice AS (
  SELECT row_id, place FROM windows WHERE c IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY row_id, a, b, c) > 1),
repeats AS (
  SELECT row_id, count(DISTINCT spot) AS n FROM (SELECT row_id, unnest([place, place + 1, place + 2]) AS spot FROM twice)
  GROUP BY row_id),
lines AS (
  SELECT row_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id),
stops AS (SELECT row_id, count(*) AS n FROM words WHERE lower(word) IN ({_STOP_WORDS}) GROUP BY row_id),
counts AS (
  SELECT doc_id, len(list)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    coalesce(lines.n, 0) AS n_lines, coalesce(stops.n, 0) AS n_stop_words,
    length(regexp_replace(text, {_CAPITAL})) AS n_capitals, length(regexp_replace(text, {_LETTER})) AS n_letters
  FROM docs LEFT JOIN lines USING (row_id) LEFT JOIN repeats USING (row_id) LEFT JOIN stops USING (row_id)),
ratios AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0::DOUBLE END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0::DOUBLE END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0.0::DOUBLE END AS stop_word_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0::DOUBLE END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0::DOUBLE END AS repeat_word_ratio,
    CASE WHEN n_letters > 0 THEN n_capitals / n_letters ELSE 0.0::DOUBLE END AS capital_ratio
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words BETWEEN 50 AND 100000 AND mean_word_chars BETWEEN 2.0 AND 15.0 AND symbol_ratio <= 0.1
    AND stop_word_ratio >= 0.02 AND dup_line_ratio <= 0.5 AND repeat_word_ratio <= 0.5 AND capital_ratio <= 0.5 AS kept,
  mean_word_chars, symbol_ratio, stop_word_ratio, dup_line_ratio, repeat_word_ratio, capital_ratio
FROM ratios
"""

_TEMPLATES = ",\n".join(
    f"({_quoted(t.label)}, {number}, {_quoted(t.text)}, {str(t.base).lower()})" for number, t in enumerate(TEMPLATES)
)
_FUNCTION_WORDS = ", ".join(_quoted(w) for w in FUNCTION_WORDS)
_WORDS = (
    r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
LICENSES = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, {_WORDS.format("coalesce(text, '')")} AS list FROM documents),
templates AS (
  SELECT label, number, base, {_WORDS.format("text")} AS list FROM (VALUES {_TEMPLATES}) AS t(label, number, text, base)),
template_grams AS (
  SELECT * FROM (
    SELECT number, label, base, len(list) AS size, unnest(list[1:len(list) - 1]) AS a, unnest(list[2:]) AS b,
      unnest(generate_series(0, len(list) - 2)) AS place
    FROM templates)
  WHERE NOT (a IN ({_FUNCTION_WORDS}) AND b IN ({_FUNCTION_WORDS}))),
shapes AS (
  SELECT number, label, base, size, count(*) AS n_grams,
    CASE WHEN count(*) <= {SHORT_GRAMS} THEN 1.0 ELSE {COVERAGE} END AS share,
    CASE WHEN count(*) <= {SHORT_GRAMS} THEN 0 ELSE {SLACK} END AS slack
  FROM template_grams GROUP BY ALL),
grams AS (
  SELECT row_id, unnest(list[1:len(list) - 1]) AS a, unnest(list[2:]) AS b, unnest(generate_series(0, len(list) - 2)) AS place
  FROM docs WHERE len(list) > 1),
votes AS (
  SELECT g.row_id, t.number, g.place - t.place AS diagonal, t.place AS t_place
  FROM grams g JOIN template_grams t USING (a, b)),
banded AS (
  SELECT *, sum(CASE WHEN diagonal - before > slack OR before IS NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY row_id, number ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS band
  FROM (
    SELECT v.*, s.slack, lag(diagonal) OVER (PARTITION BY row_id, v.number ORDER BY diagonal) AS before
    FROM votes v JOIN shapes s USING (number))),
wide AS (
  SELECT row_id, number, band, min(diagonal + t_place) AS start, max(diagonal + t_place) + 2 AS stop FROM banded GROUP BY ALL),
strongest AS (
  SELECT row_id, number, band, arg_min(diagonal, (-n, diagonal)) AS main
  FROM (SELECT row_id, number, band, diagonal, count(*) AS n FROM banded GROUP BY ALL) GROUP BY ALL),
nearest AS (
  SELECT row_id, number, band, t_place, diagonal + t_place AS place
  FROM banded JOIN strongest USING (row_id, number, band)
  QUALIFY row_number() OVER (PARTITION BY row_id, number, band, t_place ORDER BY abs(diagonal - main), diagonal) = 1),
in_order AS (
  SELECT row_id, number, band, count(*) FILTER (before IS NULL OR place > before) AS covered
  FROM (SELECT *, lag(place) OVER (PARTITION BY row_id, number, band ORDER BY t_place) AS before FROM nearest) GROUP BY ALL),
spans AS (
  SELECT row_id, label, base, covered / n_grams AS coverage, start
  FROM in_order JOIN wide USING (row_id, number, band) JOIN shapes USING (number)
  WHERE covered >= share * n_grams AND stop - start <= {STRETCH} * size),
found AS (
  SELECT row_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
    max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM spans GROUP BY row_id)
SELECT doc_id, len(list)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN found USING (row_id)
"""


PII_KEY = "example key"
_TOKEN = _quoted(
    r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9.-]{1,190}\.[A-Za-z]{2,24}"
    r"|\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}"
    r"|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{1,19}(?:-[0-9]{1,19})+|[0-9]{1,19}(?:\.[0-9]{1,19})+"
    r"|[0-9]{1,19}(?:/[0-9]{1,19})+|[0-9]{13,}"
)


def _round(number: int) -> str:
    """One round of the permutation: the halves take turns."""
    changed, other = ("a", "b") if number % 2 else ("b", "a")
    digest = f"('0x' || substr(sha256(concat_ws('|', {_quoted(PII_KEY)}, kind, size_a, size_b, {number}, {other})), 1, 12))::BIGINT"
    return f"SELECT * REPLACE (({changed} + {digest}) % size_{changed} AS {changed}) FROM round{number - 1}"


def _check_digit(digits: str) -> str:
    digit = f"substr({digits}, i, 1)::INT"
    weighed = f"CASE WHEN (length({digits}) - i) % 2 <> 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END"
    return f"(10 - list_sum([{weighed} FOR i IN generate_series(1, length({digits}))]) % 10) % 10"


PERSONAL_DATA = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, text, regexp_extract_all(text, {_TOKEN}) AS found,
    regexp_split_to_array(text, {_TOKEN}) AS pieces
  FROM documents),
tokens AS (SELECT row_id, unnest(found) AS m, unnest(generate_series(1, len(found))) AS n FROM docs),
dated AS (
  SELECT *, CASE WHEN regexp_full_match(m, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(m AS DATE)
    WHEN regexp_full_match(m, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN try_cast(m[7:10] || '-' || m[4:5] || '-' || m[1:2] AS DATE) END AS day
  FROM tokens),
kinds AS (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits, CASE
    WHEN m LIKE '%@%' THEN 'email'
    WHEN m[1] IN ('+', '(') OR regexp_full_match(m, '[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}') THEN 'phone'
    WHEN regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') THEN
      CASE WHEN regexp_matches(m, '^(000|666|9)|-00-|-0000$') THEN NULL ELSE 'ssn' END
    WHEN regexp_full_match(m, '((25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])[.]){{3}}(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])') THEN 'ip'
    WHEN year(day) BETWEEN 1700 AND 2099 THEN 'date'
    WHEN regexp_full_match(m, '[0-9]{{13,19}}|[0-9]{{4}}( [0-9]{{4}}){{3}}|[0-9]{{4}}(-[0-9]{{4}}){{3}}') THEN 'card' END AS kind
  FROM dated),
checked AS (
  SELECT * REPLACE (CASE WHEN kind = 'card' AND digits[-1] <> ({_check_digit("digits[:-2]")})::BIGINT::VARCHAR THEN NULL ELSE kind END AS kind)
  FROM kinds),
bodies AS (
  SELECT *, CASE WHEN m LIKE '+%' THEN regexp_extract(m, '[0-9]+') ELSE '' END AS fixed,
    CASE WHEN kind = 'card' THEN digits[:-2] WHEN kind = 'phone' AND m LIKE '+%' THEN digits[length(regexp_extract(m, '[0-9]+')) + 1:]
      WHEN kind IN ('phone', 'ssn') THEN digits END AS body,
    string_split(m, '.') AS octets, date_diff('day', DATE '1700-01-01', day) AS since
  FROM checked),
round0 AS (
  SELECT *, length(body) // 2 AS half,
    CASE kind WHEN 'ip' THEN octets[1]::BIGINT * 256 + octets[2]::BIGINT WHEN 'date' THEN since // 5411
      ELSE try_cast(body[1:length(body) // 2] AS BIGINT) END AS a,
    CASE kind WHEN 'ip' THEN octets[3]::BIGINT * 256 + octets[4]::BIGINT WHEN 'date' THEN since % 5411
      ELSE try_cast(body[length(body) // 2 + 1:] AS BIGINT) END AS b,
    CASE kind WHEN 'ip' THEN 65536 WHEN 'date' THEN 27 ELSE (10 ** (length(body) // 2))::BIGINT END AS size_a,
    CASE kind WHEN 'ip' THEN 65536 WHEN 'date' THEN 5411 ELSE (10 ** (length(body) - length(body) // 2))::BIGINT END AS size_b
  FROM bodies),
{", ".join(f"round{r} AS ({_round(r)})" for r in range(1, 9))},
permuted AS (
  SELECT *, lpad(a::VARCHAR, half::INT, '0') || lpad(b::VARCHAR, (length(body) - half)::INT, '0') AS new_body FROM round8),
numbers AS (
  SELECT *, fixed || new_body || CASE WHEN kind = 'card'
    THEN ({_check_digit("new_body")})::BIGINT::VARCHAR ELSE '' END AS new_digits
  FROM permuted),
renewed AS (
  SELECT row_id, n, kind, CASE
    WHEN kind = 'email' THEN 'u' || substr(sha256(concat_ws('|', {_quoted(PII_KEY)}, 'email', lower(m))), 1, 12) || '@mail.invalid'
    WHEN kind = 'ip' THEN concat_ws('.', a // 256, a % 256, b // 256, b % 256)
    WHEN kind = 'date' THEN CASE WHEN m LIKE '%-%' THEN strftime(DATE '1700-01-01' + (a * 5411 + b)::INT, '%Y-%m-%d')
      ELSE strftime(DATE '1700-01-01' + (a * 5411 + b)::INT, '%d/%m/%Y') END
    WHEN kind IS NULL THEN m
    ELSE array_to_string([CASE WHEN m[i] BETWEEN '0' AND '9' THEN new_digits[length(regexp_replace(m[1:i], '[^0-9]', '', 'g'))]
      ELSE m[i] END FOR i IN generate_series(1, length(m))], '') END AS new
  FROM numbers),
joined AS (
  SELECT row_id, string_agg(new || pieces[n + 1], '' ORDER BY n) AS rest, count(kind) AS n_replaced,
    {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "phone", "card", "ssn", "ip", "date"))}
  FROM renewed JOIN docs USING (row_id) GROUP BY row_id)
SELECT doc_id, CASE WHEN rest IS NULL THEN text ELSE pieces[1] || rest END AS text,
  {", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in ("n_replaced", "n_email", "n_phone", "n_card", "n_ssn", "n_ip", "n_date"))}
FROM docs LEFT JOIN joined USING (row_id)
"""


_UNIT_WORDS = ", ".join(_quoted(u) for u in UNIT_WORDS)


def _spelled(table: str, id_column: str) -> str:
    """(key, place, word, slot): each word in lower case, with its placeholder or null."""
    word = r"([^\p{L}\p{N}]*)(\p{N}+(?:[.,]\p{N}+)*|\p{L}+)"
    return rf"""
    SELECT key, place, lower(word) AS word, CASE
        WHEN regexp_matches(word, '^\p{{N}}') THEN '0'
        WHEN regexp_full_match(word, '\p{{Lu}}\p{{Ll}}+') AND (
          before IS NULL AND gap = '' OR gap[-1] IN ('.', '?', '!', chr(10), '"', '“', '(')
          OR gap[-1] IN (' ', chr(9)) AND (
            length(gap) > 1 AND gap[-2] IN (',', ';', ':', '.', '?', '!', chr(10), '"', '“', '(')
            OR length(gap) = 1 AND (regexp_matches(before, '\p{{Ll}}$') OR regexp_matches(before, '^\p{{N}}'))))
          THEN '1'
        WHEN lower(word) IN ({_UNIT_WORDS}) AND regexp_matches(before, '^\p{{N}}') AND gap IN ('', ' ', chr(9)) THEN '2' END AS slot
    FROM (
      SELECT *, lag(word) OVER (PARTITION BY key ORDER BY place) AS before FROM (
        SELECT key, unnest(gaps) AS gap, unnest(words) AS word, unnest(generate_series(0, len(words) - 1)) AS place
        FROM (
          SELECT struct_pack(id := {id_column}, text := text) AS key,
            regexp_extract_all(text, '{word}', 1) AS gaps, regexp_extract_all(text, '{word}', 2) AS words
          FROM (SELECT DISTINCT {id_column}, coalesce(text, '') AS text FROM {table}))))"""


CONTAMINATION = f"""
WITH doc_words AS ({_spelled("documents", "doc_id")}),
item_words AS ({_spelled("(SELECT * FROM benchmark WHERE item_id IS NOT NULL)", "item_id")}),
docs AS (SELECT key, list(coalesce(slot, word) ORDER BY place) AS words FROM doc_words GROUP BY key),
items AS (SELECT key AS item, list(coalesce(slot, word) ORDER BY place) AS words, count(*) AS n_words FROM item_words GROUP BY key),
item_windows AS (
  SELECT item, n_words, item_at, list_has_any(words[item_at + 1:item_at + {WINDOW}], ['0', '1', '2']) AS has_slot,
    array_to_string(words[item_at + 1:item_at + {WINDOW}], ' ') AS run
  FROM (SELECT *, unnest(generate_series(0, n_words - {WINDOW})) AS item_at FROM items WHERE n_words >= {WINDOW})),
doc_windows AS (
  SELECT key, doc_at, array_to_string(words[doc_at + 1:doc_at + {WINDOW}], ' ') AS run
  FROM (SELECT key, words, unnest(generate_series(0, len(words) - {WINDOW})) AS doc_at FROM docs)),
votes AS (
  SELECT DISTINCT key, item, n_words, item_at, doc_at, doc_at - item_at AS shift, has_slot FROM doc_windows JOIN item_windows USING (run)),
shifts AS (
  SELECT *, sum(opens) OVER (PARTITION BY key, item ORDER BY shift) AS alignment FROM (
    SELECT *, CASE WHEN shift - lag(shift) OVER (PARTITION BY key, item ORDER BY shift) <= 1 THEN 0 ELSE 1 END AS opens
    FROM (SELECT DISTINCT key, item, shift FROM votes))),
aligned AS (SELECT v.*, alignment FROM votes v JOIN shifts USING (key, item, shift)),
places AS (
  SELECT DISTINCT key, item, alignment, n_words, item_at, false AS plain FROM aligned
  UNION ALL SELECT DISTINCT key, item, alignment, n_words, item_at, true FROM aligned WHERE NOT has_slot),
steps AS (
  SELECT *, coalesce(least(item_at - lag(item_at) OVER in_order, {WINDOW}), {WINDOW}) AS new,
    coalesce(item_at - lag(item_at) OVER in_order > {WINDOW}, false) AS breaks
  FROM places WINDOW in_order AS (PARTITION BY key, item, alignment, plain ORDER BY item_at)),
runs AS (
  SELECT *, sum(breaks::INT) OVER (PARTITION BY key, item, alignment, plain ORDER BY item_at) AS run_no FROM steps),
run_sums AS (SELECT key, item, alignment, n_words, plain, run_no, sum(new) AS run FROM runs GROUP BY ALL),
reach AS (
  SELECT key, item, alignment, n_words, plain, sum(run) AS covered, max(run) AS run FROM run_sums GROUP BY ALL),
candidates AS (SELECT * FROM reach WHERE NOT plain AND (covered >= {SHARE} * n_words OR run >= {RUN})),
spots AS (
  SELECT key, item, alignment, spot, min(shift) AS shift FROM (
    SELECT key, item, alignment, shift, unnest(generate_series(item_at, item_at + {WINDOW} - 1)) AS spot
    FROM aligned SEMI JOIN candidates USING (key, item, alignment) WHERE has_slot) GROUP BY ALL),
filled AS (
  SELECT DISTINCT s.key, s.item, s.alignment, i.slot, i.word AS item_value, d.word AS text_value
  FROM spots s JOIN item_words i ON i.key = s.item AND i.place = s.spot AND i.slot IS NOT NULL
  JOIN doc_words d ON d.key = s.key AND d.place = s.spot + s.shift AND d.slot IS NOT NULL),
verdicts AS (
  SELECT key, item, alignment, count(*) = count(DISTINCT (slot, item_value)) AND count(*) = count(DISTINCT (slot, text_value)) AS consistent,
    bool_or(item_value <> text_value) AS changed
  FROM filled GROUP BY ALL),
judged AS (
  SELECT c.key, c.item, c.n_words, CASE WHEN coalesce(consistent, true) THEN c.covered ELSE p.covered END AS covered,
    CASE WHEN coalesce(consistent, true) THEN c.run ELSE p.run END AS run,
    CASE WHEN consistent AND changed THEN 'template' ELSE 'exact' END AS kind
  FROM candidates c LEFT JOIN verdicts USING (key, item, alignment)
  LEFT JOIN (SELECT * FROM reach WHERE plain) p ON p.key = c.key AND p.item = c.item AND p.alignment = c.alignment),
brief AS (SELECT key, array_to_string(list(word ORDER BY place), ' ') AS whole, count(*) AS n FROM doc_words GROUP BY key HAVING count(*) < {WINDOW}),
brief_items AS (SELECT key AS item, array_to_string(list(word ORDER BY place), ' ') AS whole, count(*) AS n FROM item_words GROUP BY key HAVING count(*) < {WINDOW}),
held AS (
  SELECT * FROM judged WHERE covered >= {SHARE} * n_words OR run >= {RUN}
  UNION ALL SELECT b.key, i.item, i.n, i.n, i.n, 'exact' FROM brief b JOIN brief_items i USING (whole)),
ranked AS (
  SELECT key.id AS doc_id, item.id AS item_id, n_words::BIGINT AS n_words, covered::BIGINT AS n_found, run::BIGINT AS longest_run,
    covered / n_words AS coverage, kind,
    row_number() OVER (PARTITION BY key, item.id ORDER BY covered / n_words DESC, covered DESC, n_words DESC, run DESC, kind DESC) AS place
  FROM held)
SELECT doc_id, item_id, n_words, n_found, longest_run, coverage, kind FROM ranked WHERE place = 1
"""


def _bits(of: str) -> str:
    """One byte more into a CRC-32, bit by bit."""
    return f"list_reduce(list_prepend({of}, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))"


_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)), "
    f"lambda crc, byte: {_bits('xor(crc, byte)')}))"
)


def _edit(state: str, keep: dict[str, str], to: str) -> str:
    """The least cost of the edits of one row in ``state``; ``keep`` names the state after a role's initial, ``to`` that after R."""
    kept = ", ".join(f"CASE WHEN NOT must AND initial = '{initial}' THEN price + c{after} END" for initial, after in keep.items())
    return f"least(4 + c{state}, {kept}, CASE WHEN NOT must THEN 3 + price + c{to} END)"


CONVERSATIONS = rf"""
WITH RECURSIVE named AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
fated AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS fate FROM named),
placed AS (
  SELECT conv_id, turn, role, text, initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM (
    SELECT *, left(role, 1) AS initial, unnest(CASE fate WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END)
    FROM (
      SELECT conv_id, turn, fate, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM fated))),
checked AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_open,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed),
rows_ AS (SELECT *, is_blank OR is_again AS must, CASE WHEN is_open THEN 3 ELSE 0 END AS price FROM checked),
sizes AS (SELECT conv_id, max(i) AS n FROM placed GROUP BY conv_id),
costs AS (
  SELECT conv_id, n + 1 AS i, 0 AS c0, 6 AS c1, 3 AS c2, 0 AS c3 FROM sizes
  UNION ALL
  SELECT conv_id, i, least(b0, 3 + b2, 6 + b3), least(b1, 3 + b2, 6 + b3), least(b2, 3 + b3, 6 + b2), least(b3, 3 + b2, 6 + b3)
  FROM (
    SELECT r.conv_id, r.i, {_edit("0", {"s": "1", "u": "2"}, "2")} AS b0, {_edit("1", {"u": "2"}, "2")} AS b1,
      {_edit("2", {"a": "3"}, "3")} AS b2, {_edit("3", {"u": "2"}, "2")} AS b3
    FROM costs c JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i - 1)),
walk AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS lines FROM sizes
  UNION ALL
  SELECT conv_id, i + (letter <> 'I')::INTEGER,
    CASE letter WHEN 'D' THEN q WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE if(q = 2, 3, 2) END,
    audit || letter,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, if(q = 2, 'assistant:', 'user:') || if(letter = 'R', text, '')) END
  FROM (
    SELECT *, CASE WHEN now = 4 + next[q + 1] THEN 'D' WHEN now = 3 + here[if(q = 2, 4, 3)] THEN 'I'
      WHEN NOT must AND ((initial = 's' AND q = 0 AND now = price + next[2]) OR (initial = 'u' AND q <> 2 AND now = price + next[3])
        OR (initial = 'a' AND q = 2 AND now = price + next[4])) THEN 'K' ELSE 'R' END AS letter
    FROM (
      SELECT w.*, r.role, r.text, r.initial, r.must, r.price, [h.c0, h.c1, h.c2, h.c3] AS here, here[w.q + 1] AS now,
        [n.c0, n.c1, n.c2, n.c3] AS next
      FROM walk w JOIN costs h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i
      LEFT JOIN costs n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i + 1
      LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
      WHERE r.i IS NOT NULL OR w.q IN (1, 2)))),
ended AS (
  SELECT w.conv_id, w.audit, sha256(array_to_string(w.lines, chr(10))) AS repaired_sha256
  FROM walk w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = s.n + 1 WHERE w.q IN (0, 3)),
counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (is_blank) AS blank,
    count(*) FILTER (NOT is_blank AND is_again) AS duplicate, count(*) FILTER (NOT must AND is_open) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(k.c0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN costs k ON k.conv_id IS NOT DISTINCT FROM o.conv_id AND k.i = 1
"""


FILTER_AUDIT = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
marks AS (
  SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INTEGER) AS good, max((toxic IS NOT DISTINCT FROM 1)::INTEGER) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INTEGER + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER
      + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INTEGER
      + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER
      + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INTEGER AS mask
  FROM words LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM masks GROUP BY ALL),
filters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e
  WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
found AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM found
"""


URLS = rf"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract_all(
      regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%[0-9a-f]{{2}}', ' ', 'g'),
      '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words
  FROM cut),
ruled AS (
  SELECT *, CASE
      WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN ['example.net/en/', 'allow']
      WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN ['example.com/de/', 'block']
      WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN ['org/fr/', 'allow']
      WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN ['net/', 'block'] END AS fits,
    list_filter(words, lambda w: w IN ({", ".join(map(_quoted, STRICT))})) AS strict,
    list_filter(words, lambda w: w IN ({", ".join(map(_quoted, SOFT))})) AS soft,
    list_sort(list_distinct(soft)) AS distinct_soft
  FROM parsed),
weighed AS (
  SELECT *, coalesce(list_sum(list_transform(distinct_soft, lambda w: MAP {{{", ".join(f"{_quoted(t)}: {w}" for t, w in SOFT.items())}}}[w])), 0) AS weight
  FROM ruled)
SELECT page_id, host, path, fits[1] AS rule,
  coalesce(fits[2], CASE WHEN len(strict) > 0 OR (len(distinct_soft) >= {SOFT_TERMS} AND weight >= {LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
  len(strict) AS n_strict, len(soft) AS n_soft, len(distinct_soft) AS n_soft_terms, weight::BIGINT AS soft_weight,
  array_to_string(list_sort(list_distinct(list_concat(strict, soft))), ',') AS terms
FROM weighed
"""
