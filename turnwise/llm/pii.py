"""Personal data replaced by keyed pseudonyms of the same format.

Card and account numbers, phone numbers, social security numbers, IPv4 addresses and dates are found by
pattern, validated, and permuted within their format by a Feistel network: two halves take turns in adding
a keyed digest of the other, modulo their size. A permutation never maps two values to one, and equal
values get equal pseudonyms in all documents. The user name of an e-mail address becomes a keyed digest.

All of it is Spark SQL: a text is cut at its matches, the matches are rewritten, and the pieces are joined.
Work on matches is nested ``transform`` calls, so each intermediate value is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "phone", "card", "ssn", "ip", "date")
# Lengths are bounded, or a run is tried from its start only, so that no run of characters is read again from
# each of its places.
TOKEN = "|".join(
    [
        r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++@[A-Za-z0-9.-]{1,190}\.[A-Za-z]{2,24}",
        r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
        r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}",
        r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}",
        r"[0-9]{1,19}(?:-[0-9]{1,19})+",
        r"[0-9]{1,19}(?:\.[0-9]{1,19})+",
        r"[0-9]{1,19}(?:/[0-9]{1,19})+",
        r"[0-9]{13,}",
    ]
)
# One Gregorian cycle of 400 years, 27 * 5411 days: dates are permuted within it.
FIRST_DAY, FIRST_YEAR, LAST_YEAR = "1700-01-01", 1700, 2099
DAY_PARTS = (27, 5411)


def sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(value: str, pattern: str) -> str:
    return f"rlike({value}, {sql_text('^(?:' + pattern + ')$')})"


def _number(value: str, start: int, length: int) -> str:
    return f"cast(substr({value}, {start}, {length}) as int)"


def _is_date(year: str, month: str, day: str) -> str:
    leap = f"({year} % 4 = 0 and ({year} % 100 != 0 or {year} % 400 = 0))"
    last = f"case when {month} = 2 then if({leap}, 29, 28) else 30 + (({month} + floor({month} / 8)) % 2) end"
    return f"{year} between {FIRST_YEAR} and {LAST_YEAR} and {month} between 1 and 12 and {day} between 1 and ({last})"


def _kind(m: str) -> str:
    """The kind of a token, null if it is not valid as any; check digits of cards are looked at later."""
    iso = _is_date(_number(m, 1, 4), _number(m, 6, 2), _number(m, 9, 2))
    slashed = _is_date(_number(m, 7, 4), _number(m, 4, 2), _number(m, 1, 2))
    issued = f"substr({m}, 1, 3) not in ('000', '666') and substr({m}, 1, 1) != '9' and substr({m}, 5, 2) != '00' and substr({m}, 8, 4) != '0000'"
    octets = f"forall(split({m}, '[.]'), o -> cast(o as int) <= 255)"
    return f"""case
      when contains({m}, '@') then 'email'
      when {_matches(m, r"[+(].*|[0-9]{3}-[0-9]{3}-[0-9]{4}")} then 'phone'
      when {_matches(m, r"[0-9]{3}-[0-9]{2}-[0-9]{4}")} then if({issued}, 'ssn', null)
      when {_matches(m, r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}")} then if({octets}, 'ip', null)
      when {_matches(m, r"[0-9]{4}-[0-9]{2}-[0-9]{2}")} then if({iso}, 'date', null)
      when {_matches(m, r"[0-9]{2}/[0-9]{2}/[0-9]{4}")} then if({slashed}, 'date', null)
      when {_matches(m, r"[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}")} then 'card'
    end"""


def _luhn(body: str) -> str:
    """The check digit that makes ``body`` followed by it a valid number."""
    digit = f"cast(substr({body}, i, 1) as int)"
    doubled = f"if({digit} > 4, 2 * {digit} - 9, 2 * {digit})"
    total = f"aggregate(sequence(1, length({body})), 0, (s, i) -> s + if((length({body}) - i) % 2 = 0, {doubled}, {digit}))"
    return f"((10 - {total} % 10) % 10)"


def _rewritten(matches: str, key: str) -> str:
    """The array of tokens and their pseudonyms, as structs (kind, new)."""
    read = f"transform({matches}, m -> named_struct('m', m, 'digits', regexp_replace(m, '[^0-9]', ''), 'kind', {_kind('m')}))"
    wrong = f"y.kind = 'card' and right(y.digits, 1) != cast({_luhn('substr(y.digits, 1, length(y.digits) - 1)')} as string)"
    kinds = f"transform({read}, y -> named_struct('m', y.m, 'digits', y.digits, 'kind', if({wrong}, null, y.kind)))"
    # fixed: digits that stay in front; body: digits that are permuted.
    digits = "x.digits"
    fixed = "if(startswith(x.m, '+'), regexp_extract(x.m, '[0-9]+', 0), '')"
    body = f"case x.kind when 'card' then substr({digits}, 1, length({digits}) - 1) when 'phone' then substr({digits}, length({fixed}) + 1) when 'ssn' then {digits} else '' end"
    parts = f"transform({kinds}, x -> named_struct('m', x.m, 'kind', x.kind, 'fixed', {fixed}, 'digits', {digits}, 'body', {body}))"
    day = f"""datediff(if(contains(x.m, '-'),
        make_date({_number('x.m', 1, 4)}, {_number('x.m', 6, 2)}, {_number('x.m', 9, 2)}),
        make_date({_number('x.m', 7, 4)}, {_number('x.m', 4, 2)}, {_number('x.m', 1, 2)})), date'{FIRST_DAY}')"""
    octet = "cast(split(x.m, '[.]')[{}] as bigint)".format
    half = "cast(floor(length(x.body) / 2) as int)"
    a = f"""case x.kind when 'ip' then {octet(0)} * 256 + {octet(1)} when 'date' then cast(floor({day} / {DAY_PARTS[1]}) as bigint)
        when 'email' then 0L else cast(substr(x.body, 1, {half}) as bigint) end"""
    b = f"""case x.kind when 'ip' then {octet(2)} * 256 + {octet(3)} when 'date' then cast({day} % {DAY_PARTS[1]} as bigint)
        when 'email' then 0L else cast(substr(x.body, {half} + 1) as bigint) end"""
    size_a = f"case x.kind when 'ip' then 65536L when 'date' then {DAY_PARTS[0]}L else cast(rpad('1', {half} + 1, '0') as bigint) end"
    size_b = f"case x.kind when 'ip' then 65536L when 'date' then {DAY_PARTS[1]}L else cast(rpad('1', length(x.body) - {half} + 1, '0') as bigint) end"
    valid = "if(x.kind is not null, {}, 0L)".format
    halves = f"""transform({parts}, x -> named_struct('x', x, 'a', {valid(a)}, 'b', {valid(b)},
        'size_a', if(x.kind is null, 1L, {size_a}), 'size_b', if(x.kind is null, 1L, {size_b})))"""

    def digest(other: str) -> str:
        seed = f"concat_ws('|', {sql_text(key)}, h.x.kind, h.size_a, h.size_b, r, {other})"
        return f"cast(conv(substr(sha2({seed}, 256), 1, 12), 16, 10) as bigint)"

    mixed = f"""if(h.x.kind in ('phone', 'card', 'ssn', 'ip', 'date'),
        aggregate(sequence(1, {ROUNDS}), named_struct('a', h.a, 'b', h.b), (s, r) -> if(r % 2 = 1,
          named_struct('a', (s.a + {digest('s.b')}) % h.size_a, 'b', s.b),
          named_struct('a', s.a, 'b', (s.b + {digest('s.a')}) % h.size_b))),
        named_struct('a', h.a, 'b', h.b))"""
    done = f"transform({halves}, h -> named_struct('x', h.x, 'half', length(h.size_a) - 1, 'rest', length(h.size_b) - 1, 'n', {mixed}))"
    permuted = "concat(if(d.half > 0, lpad(cast(d.n.a as string), d.half, '0'), ''), lpad(cast(d.n.b as string), d.rest, '0'))"
    check = _luhn("d.body")
    bodies = f"transform({done}, d -> named_struct('x', d.x, 'n', d.n, 'body', if(d.x.kind in ('phone', 'card', 'ssn'), {permuted}, '')))"
    numbers = f"transform({bodies}, d -> named_struct('x', d.x, 'n', d.n, 'digits', concat(d.x.fixed, d.body, if(d.x.kind = 'card', cast({check} as string), ''))))"
    spot = "length(regexp_replace(substr(d.x.m, 1, i), '[^0-9]', ''))"
    filled = f"""array_join(transform(sequence(1, length(d.x.m)), i ->
        if(rlike(substr(d.x.m, i, 1), '[0-9]'), substr(d.digits, {spot}, 1), substr(d.x.m, i, 1))), '')"""
    new_day = f"date_add(date'{FIRST_DAY}', cast(d.n.a * {DAY_PARTS[1]} + d.n.b as int))"
    user = f"substr(sha2(concat_ws('|', {sql_text(key)}, 'email', lower(d.x.m)), 256), 1, 12)"
    new = f"""case
      when d.x.kind = 'email' then concat('u', {user}, '@mail.invalid')
      when d.x.kind = 'ip' then concat_ws('.', cast(floor(d.n.a / 256) as int), d.n.a % 256, cast(floor(d.n.b / 256) as int), d.n.b % 256)
      when d.x.kind = 'date' then date_format({new_day}, if(contains(d.x.m, '-'), 'yyyy-MM-dd', 'dd/MM/yyyy'))
      when d.x.kind in ('phone', 'card', 'ssn') then {filled}
      else d.x.m end"""
    return f"transform({numbers}, d -> named_struct('kind', d.x.kind, 'new', {new}))"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in every whole text replaced by pseudonyms under ``key``.

    Result: one row per row of ``docs``: doc_id as it is (also null), text (null stays null; a text without
    valid matches is unchanged), and the number of replacements in all and per kind. Card numbers are those
    with a right check digit; their pseudonyms keep length and separators and have one too. Social security numbers
    are those that can be issued (no area 000, 666 or from 900 on, no group 00, no serial 0000). Phone numbers keep country code and
    separators; dates (1700 to 2099, ``yyyy-mm-dd`` or ``dd/mm/yyyy``) and addresses stay valid. What only looks
    like one of these (octets over 255, the 30th of February) is left alone. Other columns are not read; an
    empty table gives an empty result. Work per text: one pass of the pattern, two where it matches.
    """
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.regexp_extract_all(F.col("text").cast("string"), F.lit(TOKEN), F.lit(0)).alias("_found"),
    )
    new = found.select(
        "doc_id",
        "text",
        F.expr(f"if(size(_found) > 0, {_rewritten('_found', key)}, null)").alias("_new"),
        F.when(F.size("_found") > 0, F.split("text", TOKEN, -1)).alias("_pieces"),
    )
    joined = F.expr("array_join(transform(arrays_zip(_pieces, _new), p -> concat(p._pieces, coalesce(p._new.new, ''))), '')")
    counts = [F.expr(f"cast(if(_new is null, 0, size(filter(_new, x -> x.kind = '{k}'))) as bigint) n_{k}") for k in KINDS]
    return new.select(
        "doc_id",
        F.when(F.col("_new").isNull(), F.col("text")).otherwise(joined).alias("text"),
        F.expr("cast(if(_new is null, 0, size(filter(_new, x -> x.kind is not null))) as bigint) n_replaced"),
        *counts,
    )
