"""SQL for DuckDB with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..sources.tables import RU_CORPUS_SQL

RU = f"ru AS ({RU_CORPUS_SQL})"
_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
_CITY = "[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
_TOWN = _CITY + r"(?:\s[А-ЯЁ][а-яё]+)?"
_STREET = r"[А-ЯЁ][а-яёА-ЯЁ\-]+(?:\s[а-яёА-ЯЁ\-]+)?"


def _found(table: str, pattern: str, group: str = "0") -> str:
    """doc_id, text, value and start of all matches. RE2 knows no lookaround, so patterns are fenced afterwards."""
    return f"""SELECT doc_id, text, m[i] AS value,
  (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INT AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM {table} WHERE regexp_matches(text, '{pattern}')))"""


def _fenced(where: str = "true", digits: str = "[0-9]") -> str:
    """Matches in ``f`` that no digit touches."""
    return f"NOT regexp_matches(substr(text, start, 1), '^{digits}$') AND NOT regexp_matches(substr(text, start + length(value) + 1, 1), '^{digits}$') AND {where}"


def _out(kind: str, confidence: str, source: str, where: str = "true") -> str:
    return f"SELECT doc_id, '{kind}' AS type, value, start, (start + length(value))::INT AS \"end\", {confidence}::DOUBLE AS confidence FROM ({source}) f WHERE {where}"


def _around(radius: int) -> str:
    return f"lower(substr(text, greatest(start - {radius}, 0) + 1, start + length(value) + {radius} - greatest(start - {radius}, 0)))"


def _near(words: tuple[str, ...], radius: int) -> str:
    return "(" + " OR ".join(f"contains({_around(radius)}, '{w}')" for w in words) + ")"


def _luhn(d: str) -> str:
    n = f"length({d})"
    digit = f"substr({d}, {n} - i, 1)::INT"
    return f"(list_sum(list_transform(range({n}), lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)"


def _check(d: str, weights: tuple[int, ...]) -> str:
    return "((" + " + ".join(f"substr({d}, {i}, 1)::INT * {w}" for i, w in enumerate(weights, 1)) + ") % 11 % 10)"


def _inn(d: str) -> str:
    return f"CASE WHEN length({d}) = 10 THEN {_check(d, fv.INN_10)} = substr({d}, 10, 1)::INT WHEN length({d}) = 12 THEN {_check(d, fv.INN_11)} = substr({d}, 11, 1)::INT AND {_check(d, fv.INN_12)} = substr({d}, 12, 1)::INT ELSE false END"


def _detector(kind: str, confidence: str, pattern: str, where: str = "true", table: str = "ru") -> str:
    return f"WITH {RU} {_out(kind, confidence, _found(table, pattern), where)}" if table == "ru" else _out(kind, confidence, _found(table, pattern), where)


def _grouped(kind: str, confidence: str, pattern: str) -> str:
    """Where the value is a group at the end of the match."""
    inner = f"SELECT doc_id, text, regexp_extract(value, '{pattern}', 1) AS value, (start + length(value) - length(regexp_extract(value, '{pattern}', 1)))::INT AS start FROM ({_found('ru', pattern)})"
    return f"WITH {RU} {_out(kind, confidence, inner)}"


def _hmac(text: str, key: bytes) -> str:
    pad = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in pad).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


_MONTHS = "|".join(fv.MONTHS)
_MONTH_OF = "CASE " + " ".join(f"WHEN contains(lower(value), '{m}') THEN {i}" for i, m in enumerate(fv.MONTHS, 1)) + " END"
_DATES = f"""WITH {RU}, f AS (
  SELECT *, regexp_extract(value, '[0-9]+') AS a, regexp_extract(value, '([0-9]+)$', 1) AS z FROM ({_found('ru', '[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}')})
  WHERE {_fenced("regexp_extract(value, '([./-])', 1) = regexp_extract(value, '[0-9]+[./-][0-9]+([./-])', 1)")}
  UNION ALL SELECT *, '', '' FROM ({_found('ru', '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}')}) WHERE {_fenced()}
  UNION ALL SELECT *, '', '' FROM ({_found('ru', '[0-9]{1,2} +(?:' + _MONTHS + ') +[0-9]{4}')}) WHERE {_fenced()}),
g AS (SELECT *, CASE WHEN a <> '' THEN try_strptime(replace(replace(value, '/', '.'), '-', '.'), '%d.%m.%Y') WHEN regexp_matches(value, '^[0-9]{{4}}-') THEN try_strptime(value, '%Y-%m-%d')
  ELSE try_strptime(regexp_extract(value, '^[0-9]+') || '.' || {_MONTH_OF} || '.' || regexp_extract(value, '[0-9]{{4}}$'), '%d.%m.%Y') END AS day,
  CASE WHEN {_near(fv.BIRTH_NEAR, 30)} THEN 'BIRTH_DATE' WHEN {_near(fv.ISSUE_NEAR, 30)} THEN 'PASSPORT_ISSUE_DATE' END AS type FROM f)
SELECT doc_id, type, value, start, (start + length(value))::INT AS "end", 0.85::DOUBLE AS confidence FROM g WHERE day IS NOT NULL AND type IS NOT NULL"""

def _phones(table: str) -> str:
    """Local numbers, and foreign ones of 8 to 15 digits that no local one overlaps."""
    local = _out("PHONE", "0.95", _found(table, r"(?:[+]7|8)[\s-]?\(?[0-9]{3}\)?[\s-]?[0-9]{3}[\s-]?[0-9]{2}[\s-]?[0-9]{2}"), _fenced())
    digits = "length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"
    abroad = _out("PHONE", "0.75", _found(table, r"[+][0-9]{1,3}(?:[\s-]?[0-9]{2,4}){2,5}"), _fenced(digits))
    return f"""{local} UNION ALL SELECT * FROM ({abroad}) x WHERE NOT EXISTS (SELECT 1 FROM ({local}) y WHERE y.doc_id = x.doc_id AND y.start < x."end" AND x.start < y."end")"""


_PASSPORT = f"""WITH {RU}, a AS ({_out('PASSPORT', '0.97', _found('ru', '[Сс][Ее][Рр][Ии][Яя] *[0-9]{4} *(?:№|номер)? *[0-9]{6}'))}),
b AS ({_out('PASSPORT', '0.95', _found('ru', '[0-9]{4} *№ *[0-9]{6}'), _fenced())}),
two AS ({_out('PASSPORT', '0.75', _found('ru', '[0-9]{2} [0-9]{2} [0-9]{6}'), _fenced(_near(fv.PASSPORT_NEAR, 40)))}),
d AS ({_out('PASSPORT', '0.7', _found('ru', '[0-9]{4} [0-9]{6}'), _fenced(_near(fv.PASSPORT_NEAR, 40)))} UNION ALL SELECT * FROM two),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a."end"))
SELECT * FROM ab UNION ALL SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM ab WHERE ab.doc_id = d.doc_id AND ab.start < d."end" AND d.start < ab."end")"""

_LICENSE = f"""WITH {RU}, a AS ({_out('DRIVER_LICENSE', '0.8', _found('ru', '[0-9]{2} [0-9]{2} [0-9]{6}'), _fenced(_near(fv.LICENSE_NEAR, 40)))}),
c AS ({_out('DRIVER_LICENSE', '0.72', _found('ru', '[0-9]+'), "length(value) = 10 AND " + _near(fv.LICENSE_NEAR, 40))}
  UNION ALL {_out('DRIVER_LICENSE', '0.78', _found('ru', '[0-9]{4} [0-9]{6}'), _fenced(_near(fv.LICENSE_NEAR, 40)))})
SELECT * FROM a UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = c.doc_id AND a.start < c."end" AND c.start < a."end")"""

_ADDRESS_PARTS = (
    ("0.95", rf"[0-9]{{6}},\s*г\.\s*{_TOWN},\s*ул\.\s*{_STREET},\s*д\.\s*[0-9]+,\s*кв\.\s*[0-9]+", "true"),
    ("0.93", rf"г\.\s*{_TOWN},\s*ул\.\s*{_STREET},\s*дом\s*[0-9]+,\s*квартира\s*[0-9]+", "true"),
    ("0.7", rf"{_TOWN},\s*{_STREET},\s*[0-9]+-[0-9]+", r"NOT regexp_matches(substr(text, start, 1), '^[,\p{L}\p{N}_]$')"),
)
_ADDRESS = " UNION ALL ".join(_out("ADDRESS", c, _found("ru", p), w) for c, p, w in _ADDRESS_PARTS)
_CARD_RUNS = "[0-9]+(?:[ -][0-9]+)*"
_D = "regexp_replace(value, '[^0-9]', '', 'g')"
_CARD = _out("CARD_NUMBER", "0.95", _found("ru", _CARD_RUNS), f"length({_D}) BETWEEN 13 AND 19 AND {_luhn(_D)}")
_CARD_DOCUMENTS = _out("CARD_NUMBER", "0.95", _found("documents", "[0-9]+"), f"length(value) BETWEEN 13 AND 19 AND {_luhn('value')}")
_INN_DOCUMENTS = _out("INN", "0.9", _found("documents", "[0-9]+"), f"length(value) IN (10, 12) AND {_inn('value')}")

_PIN_ROWS = _out("PIN", "0.85", _found("ru", "[0-9]+"), f"length(value) = 4 AND {_near(fv.PIN_NEAR, 25)}")
_MASK_DIGITS = "regexp_replace({}, '[0-9]', '*', 'g')"


def _hit(window: str, word: str) -> str:
    escaped = word.replace("-", r"\-")
    return rf"regexp_matches({window}, '(^|[^\p{{L}}\p{{N}}_-]){escaped}[\p{{L}}\p{{N}}_-]{{0,2}}([^\p{{L}}\p{{N}}_-]|$)')"


_HITS = ", ".join(f"CASE WHEN {_hit('t', w)} THEN '{p}:{w}' END" for words, p in ((fv.ROLES, "role"), (fv.ACTIONS, "action"), (fv.STRONG_PII, "strong_pii"), (fv.PUBLIC_MARKERS, "public_marker")) for w in words)

_CUSTOMER_RAW = "lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' ' || lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0')"

_FLAGSHIP = f"""WITH s AS ({_out('EMAIL', '0.95', _found('documents', _EMAIL))} UNION ALL {_CARD_DOCUMENTS} UNION ALL {_INN_DOCUMENTS}),
r AS (SELECT *, CASE type WHEN 'EMAIL' THEN regexp_replace(value, '[\\p{{L}}\\p{{N}}]', '*', 'g')
  WHEN 'CARD_NUMBER' THEN substr(value, 1, 4) || repeat('*', length(value) - 8) || substr(value, -4)
  ELSE substr(value, 1, 2) || repeat('*', length(value) - 4) || substr(value, -2) END AS new,
  coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev FROM s),
p AS (SELECT r.doc_id, count(*) AS n, max("end") AS last, string_agg(substr(d.text, prev + 1, start - prev) || new, '' ORDER BY start) AS head FROM r JOIN documents d USING (doc_id) GROUP BY r.doc_id)
SELECT doc_id, coalesce(n, 0)::INT AS n_found, CASE WHEN n IS NULL THEN text ELSE head || substr(text, last + 1) END AS masked_text, sha256(text) AS fingerprint FROM documents LEFT JOIN p USING (doc_id)"""

_OVERLAPS = """WITH RECURSIVE c AS (SELECT o_custkey AS doc_id, o_orderkey AS k, (o_orderkey * 13 % 97)::INT AS s, (o_orderkey * 13 % 97 + 3 + o_orderkey % 11)::INT AS e,
  row_number() OVER (PARTITION BY o_custkey ORDER BY -((o_orderkey % 4 + 5) / 10.0), (o_orderkey * 13 % 97) - (o_orderkey * 13 % 97 + 3 + o_orderkey % 11), o_orderkey * 13 % 97, o_orderkey % 1000003) AS i
  FROM orders),
g AS (SELECT doc_id, 1 AS i, [struct_pack(k := k, s := s, e := e)] AS acc FROM c WHERE i = 1
  UNION ALL SELECT g.doc_id, g.i + 1, CASE WHEN len(list_filter(acc, lambda x: x.s < c.e AND c.s < x.e)) > 0 THEN acc ELSE list_append(acc, struct_pack(k := c.k, s := c.s, e := c.e)) END
  FROM g JOIN c ON c.doc_id = g.doc_id AND c.i = g.i + 1),
f AS (SELECT doc_id, arg_max(acc, i) AS acc FROM g GROUP BY doc_id)
SELECT doc_id, x.k::VARCHAR AS value, x.s AS start, x.e AS "end" FROM (SELECT doc_id, unnest(acc) AS x FROM f)"""

_TOKENS_FROM = f"""{RU}, docs AS (SELECT (doc_id // 40)::BIGINT AS doc_id, string_agg(text, chr(10) ORDER BY ru.doc_id) AS text FROM ru GROUP BY 1),
s AS ({_out('EMAIL', '0.95', _found('docs', _EMAIL))}
  UNION ALL {_phones('docs')}
  UNION ALL {_out('INN', '0.9', _found('docs', '[0-9]+'), f"length(value) IN (10, 12) AND {_inn('value')}")}
  UNION ALL {_out('CARD_NUMBER', '0.95', _found('docs', _CARD_RUNS), f"length({_D}) BETWEEN 13 AND 19 AND {_luhn(_D)}")}
  UNION ALL {_out('CITIZENSHIP', '0.85', "SELECT doc_id, text, regexp_extract(value, ': (.*)$', 1) AS value, (start + 13)::INT AS start FROM (" + _found('docs', 'гражданство: [А-ЯЁ][а-яё]+') + ")")}
  UNION ALL {_out('DEPARTMENT_CODE', '0.92', _found('docs', '[0-9]{3}-[0-9]{3}'), _fenced(_near(fv.DEPARTMENT_NEAR, 40)))})"""
_TOKEN_ENTITIES = f"""WITH {_TOKENS_FROM},
e AS (SELECT doc_id, type, lower(trim(value)) AS k, min(start) AS first, arg_min(value, start) AS original, count(DISTINCT value) AS n FROM s GROUP BY doc_id, type, lower(trim(value))),
i AS (SELECT *, CASE WHEN type = 'CARD_NUMBER' THEN 'CARD' ELSE type END || '_' || row_number() OVER (PARTITION BY doc_id, type ORDER BY first) AS entity_id FROM e)
SELECT doc_id, entity_id, type, original, '<' || entity_id || '>' AS token, n::INT AS n_aliases,
  CASE type WHEN 'PHONE' THEN regexp_extract(original, '^[^0-9]*[0-9]') || regexp_replace(substr(original, length(regexp_extract(original, '^[^0-9]*[0-9]')) + 1), '[0-9]', '*', 'g')
  WHEN 'INN' THEN substr(original, 1, 2) || repeat('*', length(original) - 4) || substr(original, -2)
  WHEN 'CARD_NUMBER' THEN substr(original, 1, 4) || regexp_replace(substr(original, 5, length(original) - 8), '[0-9]', '*', 'g') || substr(original, -4)
  ELSE regexp_replace(original, '[\\p{{L}}\\p{{N}}]', '*', 'g') END AS partial FROM i"""

# Ordered folds by recursion: one step for each event of every worker, backend or user.
_GATE = """WITH RECURSIVE e AS (SELECT user_id % 50 AS worker, event_id AS seq, event_id % 3 = 2 AS rel, CASE WHEN event_id % 3 = 2 THEN event_id - 2 ELSE event_id END AS request,
    500.0::DOUBLE + event_id * 31 % 5000 AS cost, event_id * 37 % 12500 AS rss, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i FROM events),
  g AS (SELECT worker, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::VARCHAR AS event, NULL::BOOLEAN AS admitted, NULL::VARCHAR AS reason, []::STRUCT(r BIGINT, c DOUBLE)[] AS open FROM (SELECT DISTINCT worker FROM e)
  UNION ALL SELECT worker, i, seq, CASE WHEN rel THEN 'release' ELSE 'acquire' END, CASE WHEN NOT rel THEN why IS NULL END, why,
    CASE WHEN rel THEN list_filter(open, lambda x: x.r <> request) WHEN why IS NULL THEN list_append(open, {'r': request, 'c': cost}) ELSE open END
  FROM (SELECT e.*, g.open, CASE WHEN e.rel THEN NULL WHEN e.rss > 12288 THEN 'critical_pressure' WHEN len(g.open) >= 6 THEN 'in_flight_limit'
      WHEN coalesce(list_sum(list_transform(g.open, lambda x: x.c)), 0) + e.cost > 20000 THEN 'backlog_limit' END AS why
    FROM g JOIN e ON e.worker = g.worker AND e.i = g.i + 1))
SELECT worker, seq, event, coalesce(admitted, false) AS admitted, coalesce(reason, '') AS reason FROM g WHERE i > 0"""
_BREAKER = """WITH RECURSIVE e AS (SELECT user_id % 50 AS backend, event_id AS seq, epoch_us(ts) AS t, event_id * 7919 % 10 < 4 AS ok,
    row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i FROM events),
  g AS (SELECT backend, 0::BIGINT AS i, 0::BIGINT AS seq, ''::VARCHAR AS state, 0 AS failed, NULL::BIGINT AS since FROM (SELECT DISTINCT backend FROM e)
  UNION ALL SELECT backend, i, seq, now, CASE WHEN now = 'open' THEN failed WHEN ok THEN 0 ELSE failed + 1 END,
    CASE WHEN now = 'open' THEN since WHEN ok THEN NULL WHEN failed + 1 >= 3 THEN t ELSE since END
  FROM (SELECT e.*, g.failed, g.since, CASE WHEN g.failed < 3 THEN 'closed' WHEN e.t - g.since >= 10000000 THEN 'half_open' ELSE 'open' END AS now
    FROM g JOIN e ON e.backend = g.backend AND e.i = g.i + 1))
SELECT backend, seq, state FROM g WHERE i > 0"""
_RATES = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
  g AS (SELECT user_id, i, t, 0.0::DOUBLE AS rate FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.t, 0.2::DOUBLE * (e.value / greatest((e.t - g.t)::DOUBLE / 1e6::DOUBLE, 0.001::DOUBLE)) + (1 - 0.2::DOUBLE) * g.rate FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
SELECT user_id, max(i)::INT AS n, round(arg_max(rate, i), 6) AS rate FROM g GROUP BY user_id"""

ORACLES: dict[str, str] = {
    "a02_admission_gate": _GATE,
    "a05_smoothed_rates": _RATES,
    "a07_breaker": _BREAKER,
    "a09_request_metrics": """WITH a AS (SELECT ['mask', 'retry_mask', 'demask'][(event_id % 3 + 1)::INT] AS direction, CASE WHEN event_id % 17 = 0 THEN 429 WHEN event_id % 23 = 0 THEN 503 WHEN event_id % 29 = 0 THEN 409 ELSE 200 END AS status,
        (event_id % 64)::DOUBLE / 64 AS seconds, CASE WHEN event_id % 17 = 0 THEN event_id % 31 END AS wait, event_id % 900 AS tokens FROM events)
      SELECT direction, CASE WHEN status < 400 THEN 'ok' WHEN status = 429 THEN 'rejected' ELSE 'error' END AS outcome, count(*) AS requests, count(*) FILTER (status NOT IN (200, 429)) AS errors, count(*) FILTER (status = 429) AS rejects,
        sum(tokens)::BIGINT AS tokens, sum(seconds) AS seconds, max(seconds) AS slowest, """
    + ", ".join(f"count(*) FILTER (wait <= {b}) AS wait_le_{b}" for b in (1, 2, 5, 10, 15, 30))
    + " FROM a GROUP BY ALL",
    "a10_health": f"""WITH s AS (SELECT backend, arg_max(state, seq) AS state FROM ({_BREAKER}) GROUP BY backend),
      w AS (SELECT bool_or(event_id % 5 = 0) AS over FROM events)
      SELECT 'ok' AS status, CASE WHEN (SELECT count(*) FROM s) = 0 THEN 'not-configured' WHEN (SELECT count(*) FROM s WHERE state <> 'closed') = 0 THEN 'ok' ELSE 'degraded' END AS storage,
        CASE WHEN over THEN 'OVERLOADED' ELSE 'CACHE_DEGRADED' END AS load_state, (SELECT count(*) FROM s) AS backends, (SELECT count(*) FROM s WHERE state <> 'closed') AS not_closed FROM w""",
    "flagship_mask": _FLAGSHIP,
    "c01_checksums": f"""WITH c AS (SELECT c_custkey, lpad(((c_custkey * 7919 + 13) % 10000000000000)::VARCHAR, 16, '0') AS card, lpad(((c_custkey * 104729) % 10000000000)::VARCHAR, 10, '0') AS a,
      lpad(((c_custkey * 1000003) % 1000000000000)::VARCHAR, 12, '0') AS b FROM customer) SELECT c_custkey, {_luhn('card')} AS luhn, {_inn('a')} AS inn10, {_inn('b')} AS inn12 FROM c""",
    "c03_fingerprints": f"SELECT doc_id, sha256(text) AS plain, {_hmac('text', b'key')} AS keyed FROM documents",
    "c05_token_counts": "SELECT lang, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(length(text) // 4, 1) END)::BIGINT AS tokens, count(*) AS documents FROM documents GROUP BY lang",
    "c06_partial_masks": f"""WITH c AS (SELECT c_custkey, c_name, {_CUSTOMER_RAW} AS raw FROM customer)
      SELECT c_custkey, substr(raw, 1, 2) || '** ****' || substr(raw, -2) AS passport, '+7 **** ******' AS phone, substr(raw, 1, 4) || ' ******-**** **' || substr(raw, -4) AS card,
      substr(raw, 1, 2) || '** ****' || substr(raw, -2) AS inn, '**** ******' AS other, upper(regexp_extract(c_name, '\\p{{L}}')) || '.' AS name,
      '*' || repeat('*', length(c_custkey::VARCHAR)) || '@**.***' AS email, '+7' || replace(raw, ' ', '') AS normalized FROM c""",
    "c15_seeds": """WITH c AS (SELECT c_custkey, ('0x' || substr(sha256(c_custkey::VARCHAR || ':EMAIL:' || c_name), 1, 16))::UBIGINT::VARCHAR AS seed FROM customer)
      SELECT c_custkey, seed, (('0x' || substr(sha256(seed || ':0'), 1, 16))::UBIGINT % 16)::INT AS draw FROM c""",
    "d01_email": _detector("EMAIL", "0.95", _EMAIL, table="documents"),
    "d02_phone": f"WITH {RU} {_phones('ru')}",
    "d04_inn": _detector("INN", "0.9", "[0-9]+", f"length(value) IN (10, 12) AND {_inn('value')}"),
    "d04_inn_documents": _INN_DOCUMENTS,
    "d05_card": f"WITH {RU} {_CARD}",
    "d05_card_documents": _CARD_DOCUMENTS,
    "d06_passport": _PASSPORT,
    "d09_department_code": _detector("DEPARTMENT_CODE", "0.92", "[0-9]{3}-[0-9]{3}", _fenced(_near(fv.DEPARTMENT_NEAR, 40))),
    "d10_cvv": _detector("CVV", "0.9", "[0-9]+", f"length(value) = 3 AND {_near(fv.CVV_NEAR, 25)}"),
    "d11_pin": f"WITH {RU} {_PIN_ROWS}",
    "d12_driver_license": _LICENSE,
    "d13_dates": _DATES,
    "d14_cardholder": _grouped("CARDHOLDER", "0.9", r"[Дд]ержател[а-яё]*[:\s]+([А-ЯЁ]{2,}(?:\s+[А-ЯЁ]{2,}){1,2})"),
    "d15_address": f"WITH {RU} {_ADDRESS}",
    "d16_birth_place": _grouped("BIRTH_PLACE", "0.85", rf"[Мм]есто\s+рождения[^:;.]*[:\-—]\s*((?:г\.\s*|город\s+)?{_CITY}(?:,\s*Росси[ия][^,.;]*)?)"),
    "d17_citizenship": _grouped("CITIZENSHIP", "0.85", r"[Гг]ражданств[оа]\s*[:\-—]?\s*([А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?)"),
    "d18_passport_issuer": _detector("PASSPORT_ISSUER", "0.9", rf"(?:ГУ МВД России|УМВД России|Отделом? МВД России)\s+по\s+г\.\s*{_CITY}"),
    "e08_token_entities": _TOKEN_ENTITIES,
    "o1_overlaps": _OVERLAPS,
    "p04_consumer_policies": f"""WITH {RU}, q AS (SELECT ru.*, ['chat-assistant', 'analytics-pipeline', 'nobody'][(doc_id % 4)::INT] AS consumer_id FROM ru),
      s AS ({_out('EMAIL', '0.95', _found('ru', _EMAIL))} UNION ALL {_out('INN', '0.9', _found('ru', '[0-9]+'), f"length(value) IN (10, 12) AND {_inn('value')}")} UNION ALL {_CARD}
        UNION ALL {_out('CVV', '0.9', _found('ru', '[0-9]+'), f"length(value) = 3 AND {_near(fv.CVV_NEAR, 25)}")}),
      c AS (SELECT * FROM s WHERE type = 'CARD_NUMBER'),
      all_s AS (SELECT * FROM s UNION ALL SELECT * FROM ({_PIN_ROWS}) p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id AND c.start < p."end" AND p.start < c."end")),
      j AS (SELECT a.*, type <> 'PIN' OR EXISTS (SELECT 1 FROM c JOIN ru USING (doc_id) WHERE c.doc_id = a.doc_id AND greatest(a.start - c."end", c.start - a."end", 0) <= 300
        AND NOT contains(substr(ru.text, least(a."end", c."end") + 1, greatest(a.start, c.start) - least(a."end", c."end")), chr(10) || chr(10))) AS personal FROM all_s a),
      n AS (SELECT doc_id, count(*) AS found, count(*) FILTER (personal) AS masked, count(*) FILTER (personal AND type IN ('EMAIL', 'CARD_NUMBER', 'CVV', 'PIN')) AS chat FROM j GROUP BY doc_id)
      SELECT consumer_id, count(*) AS requests, CASE WHEN consumer_id = 'nobody' THEN 0 ELSE coalesce(sum(CASE WHEN consumer_id = 'chat-assistant' THEN chat ELSE masked END), 0) END::BIGINT AS masked,
      CASE WHEN consumer_id = 'nobody' THEN 0 ELSE coalesce(sum(found), 0) END::BIGINT AS found FROM q LEFT JOIN n USING (doc_id) GROUP BY consumer_id""",
    "s05_vault_inserts": """WITH e AS (SELECT user_id, event_id, ts FROM events),
      a AS (SELECT user_id, arg_min(event_id, (ts, event_id::VARCHAR)) AS id, min(ts) AS ts FROM e WHERE event_id % 2 = 0 GROUP BY user_id),
      alive AS (SELECT * FROM a WHERE ts + INTERVAL 600 SECOND > TIMESTAMP '2024-01-15'),
      b AS (SELECT user_id, arg_min(event_id, (ts, event_id::VARCHAR)) AS id FROM e WHERE event_id % 2 = 1 GROUP BY user_id)
      SELECT user_id::VARCHAR AS payload_id, id::VARCHAR AS original_fingerprint FROM alive UNION ALL SELECT user_id::VARCHAR, id::VARCHAR FROM b WHERE user_id NOT IN (SELECT user_id FROM alive)""",
    "x03_keyword_hits": f"WITH {RU}, w AS (SELECT doc_id, lower(text) AS t FROM ru) SELECT doc_id, array_to_string(list_sort(list_filter([{_HITS}], lambda x: x IS NOT NULL)), ',') AS hits FROM w",
    "a01_admission_work": """WITH d AS (SELECT doc_id, strlen(text) * 300 AS size FROM documents), s AS (SELECT *, CASE WHEN size > 3000000 THEN 413 WHEN size % 3 > 0 THEN 200 ELSE 429 END AS status FROM d)
      SELECT doc_id, 500.0::DOUBLE + size AS work, status, CASE WHEN status = 429 THEN ceil(1.5::DOUBLE * (doc_id % 7))::BIGINT ELSE 0 END AS retry_after FROM s""",
    "a03_load_states": """WITH e AS (SELECT event_id AS k, (event_id * 1009 % 400000)::DOUBLE AS o, (event_id % 50 * 100)::DOUBLE AS sv, (event_id % 70 * 90)::DOUBLE AS ar FROM events),
      p AS (SELECT *, CASE WHEN sv > 0 THEN (o + 900.0::DOUBLE) / sv ELSE greatest(0.25::DOUBLE, 1.0) END AS base, CASE WHEN sv > 0 THEN greatest(1.0::DOUBLE, ar / sv) ELSE 1.0 END AS pr FROM e)
      SELECT k AS event_id, CASE WHEN k * 37 % 13000 > 12288 THEN 'CRITICAL' WHEN k % 11 = 0 THEN 'STORAGE_DEGRADED' WHEN k % 35 >= 32 OR k * 1009 % 4000000 > 3200000 THEN 'OVERLOADED' WHEN k % 5 = 0 THEN 'CACHE_DEGRADED' ELSE 'NORMAL' END AS state,
      round(least(greatest(base * pr * 1.5::DOUBLE * CASE WHEN k % 11 = 0 THEN 2.0::DOUBLE ELSE 1.0 END, least(greatest(1.0::DOUBLE, pr / 2), 10.0::DOUBLE)), 30.0::DOUBLE), 1) AS retry_after FROM p""",
    "a09_metrics": f"""WITH m AS (SELECT doc_id, count(*) AS n FROM ({_found('documents', _EMAIL)}) GROUP BY doc_id)
      SELECT lang, count(*) AS requests, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(length(text) // 4, 1) END)::BIGINT AS tokens, coalesce(sum(n), 0)::BIGINT AS detected, coalesce(sum(n), 0)::BIGINT AS masked FROM documents LEFT JOIN m USING (doc_id) GROUP BY lang""",
}

from .oracles_flow import FLOWS  # noqa: E402  it is built from the statements above
from .oracles_names import N02  # noqa: E402
from .oracles_surrogates import SURROGATES  # noqa: E402

ORACLES |= FLOWS | {"n02_name_forms": N02} | SURROGATES
