"""SQL for DuckDB of surrogates: the same counters hashed, the same shapes, and the first attempt that is free in the text."""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..operators import synthesis as sy
from . import oracles as o
from . import oracles_flow as of

#: Attempts and draws that the statement looks at; the library goes on to twenty attempts.
TRIES, DRAWS = 8, 16


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _x(i: int | str, n: int | str) -> str:
    """The draw number i (from 0), below n."""
    return f"(hs[{i} + 1] % {n})"


def _pick(words: str, i: int) -> str:
    return f"{words}[({_x(i, f'len({words})')} + 1)::INT]"


def _digit_run(first: int, n: int | str) -> str:
    return f"array_to_string(list_transform(hs[{first} + 1:{first} + {n}], lambda h: (h % 10)::VARCHAR), '')"


_D = "regexp_replace(original, '[^0-9]', '', 'g')"
_COUNTRIES = f"list_filter({_list(fv.COUNTRIES)}, lambda c: c <> original)"
_CITIES = f"CASE WHEN len(list_filter({_list(fv.CITIES)}, lambda c: NOT contains(original, c))) > 0 THEN list_filter({_list(fv.CITIES)}, lambda c: NOT contains(original, c)) ELSE {_list(fv.CITIES)} END"
_CITY = f"({_CITIES})[(hs[1] % len({_CITIES}) + 1)::INT]"


def _date(i: int) -> str:
    day = f"(DATE '{sy.FIRST_DAY}' + {_x(i, sy._DAYS)}::INT)"
    forms = (("\\.", "%d.%m.%Y"), ("/", "%d/%m/%Y"), ("-", "%d-%m-%Y"))
    out = " ".join(f"WHEN regexp_full_match(original, '[0-9]{{1,2}}{s}[0-9]{{1,2}}{s}[0-9]{{4}}') THEN strftime({day}, '{f}')" for s, f in forms)
    return f"CASE {out} WHEN regexp_full_match(original, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN strftime({day}, '%Y-%m-%d') ELSE day({day}) || ' ' || {_list(fv.MONTHS)}[month({day})] || ' ' || year({day}) END"


def _person(i: int) -> str:
    male, female = (fv.MALE_FIRST, fv.MALE_LAST, fv.MALE_PATRONYMIC), (fv.FEMALE_FIRST, sy.FEMALE_LAST, fv.FEMALE_PATRONYMIC)
    said = lambda pools: f"{_pick(_list(pools[1]), i + 1)} || ' ' || {_pick(_list(pools[0]), i)} || ' ' || {_pick(_list(pools[2]), i + 2)}"
    return f"CASE WHEN gender = 'masc' THEN {said(male)} ELSE {said(female)} END"


def _weighted(digits: str, weights: tuple[int, ...]) -> str:
    return "((" + " + ".join(f"substr({digits}, {i}, 1)::INT * {w}" for i, w in enumerate(weights, 1)) + ") % 11 % 10)::VARCHAR"


def _redraw(value, avoided: str, step: int) -> str:
    return f"CASE WHEN {value(0)} <> {avoided} THEN {value(0)} ELSE {value(step)} END"


_BODY = f"(['4', '5', '2'][{_x(0, 3)}::INT + 1] || {_digit_run(1, 14)})"
_SUM = " + ".join(f"CASE WHEN substr(body, {i}, 1)::INT * 2 > 9 THEN substr(body, {i}, 1)::INT * 2 - 9 ELSE substr(body, {i}, 1)::INT * 2 END" if i % 2 else f"substr(body, {i}, 1)::INT" for i in range(1, 16))
_NUMBER = f"(body || ((10 - ({_SUM}) % 10) % 10)::VARCHAR)"
_JOINT = "CASE WHEN contains(original, '-') THEN '-' WHEN contains(original, ' ') THEN ' ' ELSE '' END"
_TEN = _digit_run(0, 10)
_INN_10 = f"{_digit_run(0, 9)} || {_weighted(_digit_run(0, 9), fv.INN_10)}"
_INN_11 = f"({_TEN} || {_weighted(_TEN, fv.INN_11)})"

#: The number with digits drawn anew: pieces between digits, and a drawn digit for each but those kept.
_KEEP = "CASE WHEN type = 'PHONE' THEN 1 ELSE 0 END"
_DRAWN = f"array_to_string(list_transform(string_split(original, ''), lambda c, i: CASE WHEN c >= '0' AND c <= '9' AND len(regexp_replace(substr(original, 1, i - 1), '[^0-9]', '', 'g')) >= {_KEEP} THEN (hs[len(regexp_replace(substr(original, 1, i - 1), '[^0-9]', '', 'g')) - {_KEEP} + 1] % 10)::VARCHAR ELSE c END), '')"

_VALUE = f"""CASE WHEN type IN ('FULL_NAME', 'CARDHOLDER') THEN {_redraw(_person, 'nominal', 3)}
  WHEN type IN ('BIRTH_DATE', 'PASSPORT_ISSUE_DATE') THEN {_redraw(_date, 'original', 1)}
  WHEN type IN ('PASSPORT', 'DRIVER_LICENSE', 'PHONE') THEN {_DRAWN}
  WHEN type = 'DEPARTMENT_CODE' THEN {_redraw(lambda i: f"lpad({_x(i, 1000)}::VARCHAR, 3, '0') || '-' || lpad({_x(i + 1, 1000)}::VARCHAR, 3, '0')", 'original', 2)}
  WHEN type = 'CITIZENSHIP' THEN {_COUNTRIES}[(hs[1] % len({_COUNTRIES}) + 1)::INT]
  WHEN type = 'PASSPORT_ISSUER' THEN {_redraw(lambda i: f"{_pick(_list(fv.ISSUERS), i)} || ' ' || {_pick(_list(fv.CITIES), i + 1)}", 'original', 2)}
  WHEN type = 'BIRTH_PLACE' THEN CASE WHEN starts_with(lower(original), 'г.') THEN 'г. ' || {_CITY} WHEN starts_with(lower(original), 'город') THEN 'город ' || {_CITY} WHEN contains(lower(original), 'россия') THEN {_CITY} || ', Россия' ELSE {_CITY} END
  WHEN type = 'ADDRESS' THEN ({_x(4, 600_000)} + 100000)::VARCHAR || ', г. ' || {_pick(_list(fv.CITIES), 0)} || ', ул. ' || {_pick(_list(fv.STREETS), 1)} || ', д. ' || ({_x(2, 250)} + 1)::VARCHAR || ', кв. ' || ({_x(3, 500)} + 1)::VARCHAR
  WHEN type = 'EMAIL' THEN {_pick(_list(fv.EMAIL_LOCALS), 0)} || ({_x(1, 99_990)} + 10)::VARCHAR || '@' || {_pick(_list(fv.EMAIL_DOMAINS), 2)}
  WHEN type = 'INN' THEN CASE WHEN length({_D}) = 10 THEN {_INN_10} ELSE {_INN_11} || {_weighted(_INN_11, fv.INN_12)} END
  WHEN type = 'CARD_NUMBER' THEN substr(number, 1, 4) || joint || substr(number, 5, 4) || joint || substr(number, 9, 4) || joint || substr(number, 13, 4)
  WHEN type = 'CVV' THEN {_redraw(lambda i: _digit_run(i, 3), _D, 3)} WHEN type = 'PIN' THEN {_redraw(lambda i: _digit_run(i, 4), _D, 4)} END"""

_FORMS = "forms(gender, word, c, form) AS (VALUES " + ", ".join(f"('{k.split(':')[0]}', '{k.split(':')[1]}', '{c}', '{f}')" for k, forms in sy.pool_forms().items() for c, f in zip(fv.CASES, forms, strict=True)) + ")"
_V = of._VALUES

#: CTEs up to ``made`` (doc_id, type, k, entity_id, original, synthetic) and ``spoken`` (the same by mention: start, stop, value, new), from ``decided`` on.
MADE = f"""{of.ENTITIES}, {_FORMS},
told AS (SELECT num.*, ru.text, CASE WHEN type = 'FULL_NAME' THEN replace(k, '|', ' ') ELSE original END AS nominal, CASE WHEN type = 'FULL_NAME' THEN 'person:' || lower(k) || '#1' ELSE type || ':' || k END AS key,
  CASE WHEN type = 'FULL_NAME' THEN (SELECT any_value(v.gender) FROM (VALUES {_V}) v(surface, confidence, gram_case, gender, nominal, alias, known, person) WHERE v.person = k) WHEN starts_with(original, 'ПЕТРОВА') THEN 'femn' WHEN type = 'CARDHOLDER' THEN 'masc' END AS gender
  FROM num JOIN ru USING (doc_id)),
seeded AS (SELECT *, (('0x' || substr(sha256(doc_id::VARCHAR || ':' || key), 1, 16))::UBIGINT::HUGEINT + attempt)::VARCHAR AS seed FROM told, (SELECT unnest(range({TRIES})) AS attempt)),
drawn AS (SELECT *, list_transform(range({DRAWS}), lambda i: ('0x' || substr(sha256(seed || ':' || i::VARCHAR), 1, 16))::UBIGINT) AS hs FROM seeded),
carded AS (SELECT *, {_BODY} AS body, {_JOINT} AS joint FROM drawn),
numbered AS (SELECT *, {_NUMBER} AS number FROM carded),
tried AS (SELECT doc_id, prefix, type, k, entity_id, original, text, gender, attempt, {_VALUE} AS v FROM numbered),
pairs AS (SELECT DISTINCT t.doc_id, t.type, t.k, attempt FROM tried t JOIN forms a ON a.gender = t.gender AND a.word = split_part(v, ' ', 2) JOIN forms b ON b.gender = t.gender AND b.c = a.c AND b.word IN (split_part(v, ' ', 1), split_part(v, ' ', 3))
  WHERE t.type IN ('FULL_NAME', 'CARDHOLDER') AND (contains(text, a.form || ' ' || b.form) OR b.word = split_part(v, ' ', 1) AND contains(text, b.form || ' ' || a.form))),
made AS (SELECT t.doc_id, t.prefix, t.type, t.k, entity_id, original, any_value(gender) AS gender, arg_min(v, t.attempt) AS synthetic FROM tried t LEFT JOIN pairs p ON p.doc_id = t.doc_id AND p.type = t.type AND p.k = t.k AND p.attempt = t.attempt
  WHERE p.attempt IS NULL AND NOT contains(text, v) GROUP BY t.doc_id, t.prefix, t.type, t.k, entity_id, original),
spoken AS (SELECT m.doc_id, m.type, m.start, m.stop, m.value, e.entity_id, e.synthetic, CASE WHEN m.type = 'FULL_NAME' THEN CASE v.alias WHEN 'FULL' THEN s.form || ' ' || f.form || ' ' || p.form WHEN 'NAME_SURNAME' THEN f.form || ' ' || s.form
    ELSE left(f.word, 1) || '.' || left(p.word, 1) || '. ' || s.form END ELSE e.synthetic END AS new
  FROM m JOIN made e USING (doc_id, prefix, type, k) LEFT JOIN (VALUES {_V}) v(surface, confidence, gram_case, gender, nominal, alias, known, person) ON m.type = 'FULL_NAME' AND v.surface = m.value
  LEFT JOIN forms s ON s.gender = e.gender AND s.c = v.gram_case AND s.word = split_part(e.synthetic, ' ', 1) LEFT JOIN forms f ON f.gender = e.gender AND f.c = v.gram_case AND f.word = split_part(e.synthetic, ' ', 2)
  LEFT JOIN forms p ON p.gender = e.gender AND p.c = v.gram_case AND p.word = split_part(e.synthetic, ' ', 3))"""

SURROGATES = {
    "g01_surrogates": f"""WITH RECURSIVE {of.decided()}, {MADE} SELECT doc_id, entity_id, type, start, value, synthetic, new FROM spoken""",
    "m03_synthetic_round_trip": f"""WITH RECURSIVE {of.decided()}, {of._COUNTS}, {MADE}, {of.spliced('spoken', 'new')}, same AS (SELECT doc_id, bool_or(new = value) AS leaks FROM spoken GROUP BY doc_id),
      back_s AS (SELECT doc_id, (start + coalesce(sum(length(new) - length(value)) OVER w, 0))::BIGINT AS start, (start + coalesce(sum(length(new) - length(value)) OVER w, 0) + length(new))::BIGINT AS stop, value
        FROM spoken WINDOW w AS (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), shown AS (SELECT doc_id, out AS text FROM done), {of.spliced('back_s', 'value', 'shown', 'back')}
      SELECT ru.doc_id, coalesce(n_masked, 0)::INT AS n_masked, done.out AS masked_text, coalesce(leaks, false) AS leaks, back.out = ru.text AS restored_exactly, replace(ru.text, 'И.П.', 'И. П.') AS restored
      FROM ru JOIN done USING (doc_id) JOIN back USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN same USING (doc_id)""",
}
