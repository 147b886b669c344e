"""SQL for DuckDB of whole flows over the Russian corpus: candidates of all detectors, the choice among them, decisions by
context, relations, masks and what restoring gives. Names come from a table of the names that the corpus is made of."""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..operators import compact as cp
from . import oracles as o

#: Names of the corpus: as written, confidence, case, gender, nominative, kind of alias, public figure, person.
NAMES = (
    *((f"{s} Иван Петрович", 0.85, "nomn", "masc", f"{s} Иван Петрович", "FULL", False, f"{s}|Иван|Петрович") for s in ("Иванов", "Петров", "Смирнов", "Волков")),
    ("Александр Сергеевич Пушкин", 0.85, "nomn", "masc", "Александр Сергеевич Пушкин", "FULL", True, "Пушкин|Александр|Сергеевич"),
    ("Иванову Ивану Петровичу", 0.85, "datv", "masc", "Иванов Иван Петрович", "FULL", False, "Иванов|Иван|Петрович"),
    ("Иван Иванов", 0.75, "nomn", "masc", "Иван Иванов", "NAME_SURNAME", False, "Иванов|Иван|Петрович"),
    ("И.П. Иванов", 0.7, "nomn", "masc", "Иванов", "SURNAME_INITIALS", False, "Иванов|Иван|Петрович"),
    ("Смирнова Мария Ивановна", 0.85, "nomn", "femn", "Смирнова Мария Ивановна", "FULL", False, "Смирнова|Мария|Ивановна"),
)
_VALUES = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in NAMES)
_NAMED = f"""SELECT doc_id, text, v.* FROM ru JOIN (VALUES {_VALUES}) v(surface, confidence, gram_case, gender, nominal, alias, known, person) ON contains(text, surface)"""
_NAME_ROWS = f"""WITH {o.RU} SELECT doc_id, 'FULL_NAME' AS type, surface AS value, (instr(text, surface) - 1)::INT AS start, (instr(text, surface) - 1 + length(surface))::INT AS "end", confidence::DOUBLE AS confidence FROM ({_NAMED})"""

#: The rows of each detector over the corpus.
DETECTED = {
    "email": o._detector("EMAIL", "0.95", o._EMAIL), "fio": _NAME_ROWS, "phone": o.ORACLES["d02_phone"], "inn": o.ORACLES["d04_inn"], "card": o.ORACLES["d05_card"], "passport": o.ORACLES["d06_passport"],
    "department_code": o.ORACLES["d09_department_code"], "cvv": o.ORACLES["d10_cvv"], "pin": o.ORACLES["d11_pin"], "driver_license": o.ORACLES["d12_driver_license"], "date": o.ORACLES["d13_dates"],
    "cardholder": o.ORACLES["d14_cardholder"], "address": o.ORACLES["d15_address"], "birth_place": o.ORACLES["d16_birth_place"], "citizenship": o.ORACLES["d17_citizenship"],
    "passport_issuer": o.ORACLES["d18_passport_issuer"],
}


def _reasons(window: str, words: tuple[str, ...], prefix: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {o._hit(window, w)} THEN '{prefix}:{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"


def decided(only: tuple[str, ...] = tuple(DETECTED)) -> str:
    """CTEs up to ``decided``: doc_id, type, value, start, end, confidence, decision, sure, reasons of the chosen candidates."""
    found = " UNION ALL ".join(f"SELECT doc_id, type, value, start, \"end\" AS stop, confidence, {fv.DETECTORS.index(d)} AS det FROM ({DETECTED[d]})" for d in only)
    return f"""{o.RU},
cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -confidence, start - stop, start, det) AS i FROM ({found})),
grow AS (SELECT doc_id, i, [struct_pack(s := start, e := stop, i := i)] AS acc FROM cand WHERE i = 1
  UNION ALL SELECT g.doc_id, c.i, CASE WHEN len(list_filter(acc, lambda x: x.s < c.stop AND c.start < x.e)) > 0 THEN acc ELSE list_append(acc, struct_pack(s := c.start, e := c.stop, i := c.i)) END
  FROM grow g JOIN cand c ON c.doc_id = g.doc_id AND c.i = g.i + 1),
kept AS (SELECT doc_id, unnest(arg_max(acc, i)).i AS i FROM grow GROUP BY doc_id),
chosen AS (SELECT c.*, ru.text, coalesce(lag(stop) OVER w, 0) AS prev, coalesce(lead(start) OVER w, length(ru.text)) AS next
  FROM cand c JOIN kept USING (doc_id, i) JOIN ru USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
bounds AS (SELECT *, greatest(prev, start - length(regexp_extract(substr(text, greatest(start - 220, 0) + 1, start - greatest(start - 220, 0)), '[^.!?\\n]*$'))) AS low,
  least(next, stop + length(regexp_extract(substr(text, stop + 1, 220), '^[^.!?\\n]*[.!?\\n]?'))) AS high FROM chosen),
windows AS (SELECT *, lower(substr(text, low + 1, high - low)) AS w, lower(value) AS v FROM bounds),
hits AS (SELECT *, {_reasons('w', fv.ROLES, 'role')} AS h1, {_reasons('w', fv.ACTIONS, 'action')} AS h2, {_reasons('w', fv.BANK_CONCEPTS, 'bank_concept')} AS h3,
  {_reasons('w', fv.STRONG_PII, 'strong_pii')} AS h4, {_reasons('w', fv.PUBLIC_MARKERS, 'public_marker')} AS h5,
  CASE WHEN type = 'FULL_NAME' AND contains(value, 'Пушкин') THEN ['known_public_figure'] ELSE []::VARCHAR[] END AS h6,
  {_reasons('w', fv.PERSONAL_ADDRESS, 'personal')} AS a1, list_concat({_reasons('w', fv.ORGANIZATION_ADDRESS, 'organizational')}, {_reasons('v', fv.ORGANIZATION_ADDRESS, 'organizational')}) AS a2 FROM windows),
scores AS (SELECT *, 2 * len(h1) + 2 * len(h2) + len(h3) + 3 * len(h4) AS private, 2 * len(h5) + 2 * len(h6) AS public FROM hits),
judged AS (SELECT *, CASE WHEN type = 'FULL_NAME' AND private = 0 AND public > 0 OR type = 'ADDRESS' AND len(a1) = 0 AND len(a2) > 0 THEN 'KEEP' ELSE 'MASK' END AS d0,
  CASE WHEN type = 'FULL_NAME' THEN CASE WHEN private > 0 THEN least(0.6 + 0.1 * private, 0.99) WHEN public > 0 THEN least(0.6 + 0.1 * public, 0.95) ELSE 0.55 END
    WHEN type = 'ADDRESS' THEN CASE WHEN len(a1) > 0 THEN least(0.6 + 0.1 * len(a1), 0.97) WHEN len(a2) > 0 THEN least(0.6 + 0.1 * len(a2), 0.95) ELSE 0.55 END ELSE confidence END AS c0,
  CASE WHEN type = 'FULL_NAME' THEN CASE WHEN private + public > 0 THEN list_concat(h1, h2, h3, h4, h5, h6) ELSE ['no_context_fail_safe'] END
    WHEN type = 'ADDRESS' THEN CASE WHEN len(a1) > 0 THEN a1 WHEN len(a2) > 0 THEN a2 ELSE ['no_context_fail_safe'] END ELSE ['personal_by_construction'] END AS r0,
  type = 'PIN' AND NOT EXISTS (SELECT 1 FROM scores c WHERE c.doc_id = scores.doc_id AND c.type = 'CARD_NUMBER' AND greatest(scores.start - c.stop, c.start - scores.stop, 0) <= 300
    AND NOT contains(substr(scores.text, least(scores.stop, c.stop) + 1, greatest(scores.start, c.start) - least(scores.stop, c.stop)), chr(10) || chr(10))) AS lone FROM scores),
decided AS (SELECT doc_id, text, type, value, start, stop, confidence, CASE WHEN lone THEN 'KEEP' ELSE d0 END AS decision, CASE WHEN lone THEN 0.6 ELSE c0 END::DOUBLE AS sure,
  CASE WHEN lone THEN list_append(r0, 'relationship_rule_unmet:CARD_NUMBER') ELSE r0 END AS reasons FROM judged)"""


def _digits(first: int, last: int, short_too: bool) -> str:
    head = f"regexp_extract(value, '^(?:[^0-9]*[0-9]){{{first}}}')"
    tail = f"regexp_extract(value, '(?:[0-9][^0-9]*){{{last}}}$')" if last else "''"
    stars = "regexp_replace({}, '[0-9]', '*', 'g')"
    middle = stars.format(f"substr(value, length({head}) + 1, length(value) - length({head}) - length({tail}))")
    plenty = f"length(regexp_replace(value, '[^0-9]', '', 'g')) > {first + last}"
    return f"CASE WHEN {plenty} THEN {head} || {middle} || {tail} ELSE {stars.format('value') if short_too else 'value'} END"


PARTIAL = f"""CASE WHEN type IN ('FULL_NAME', 'CARDHOLDER') THEN array_to_string(list_transform(regexp_split_to_array(trim(value), '\\s+'), lambda w: upper(regexp_extract(w, '\\p{{L}}')) || '.'), ' ')
  WHEN type = 'PHONE' THEN {_digits(1, 0, False)} WHEN type = 'PASSPORT' THEN {_digits(2, 2, False)} WHEN type = 'CARD_NUMBER' THEN {_digits(4, 4, False)}
  WHEN type IN ('DRIVER_LICENSE', 'INN') THEN {_digits(2, 2, True)} ELSE regexp_replace(value, '[\\p{{L}}\\p{{N}}]', '*', 'g') END"""

#: Entities of the masked rows in ``m``: numbered within their token's prefix by first appearance; and what the first mention says.
ENTITIES = f"""m AS (SELECT d.doc_id, d.text, d.type, d.value, d.start, d.stop, CASE d.type WHEN 'FULL_NAME' THEN 'PERSON' WHEN 'CARD_NUMBER' THEN 'CARD' ELSE d.type END AS prefix,
    CASE WHEN d.type = 'FULL_NAME' THEN v.person ELSE lower(trim(d.value)) END AS k
  FROM decided d LEFT JOIN (VALUES {_VALUES}) v(surface, confidence, gram_case, gender, nominal, alias, known, person) ON d.type = 'FULL_NAME' AND v.surface = d.value WHERE decision = 'MASK'),
ent AS (SELECT doc_id, prefix, type, k, min(start) AS first, arg_min(value, start) AS original FROM m GROUP BY doc_id, prefix, type, k),
num AS (SELECT *, prefix || '_' || row_number() OVER (PARTITION BY doc_id, prefix ORDER BY first) AS entity_id FROM ent),
tok AS (SELECT m.*, entity_id, original, '<' || entity_id || '>' AS token FROM m JOIN num USING (doc_id, prefix, type, k))"""


def spliced(spans: str, new: str, docs: str = "ru", name: str = "done") -> str:
    """CTE ``name`` (doc_id, text, n, out): the texts of ``docs`` with each of the ``spans`` replaced by the expression ``new``."""
    return f"""{name}_r AS (SELECT doc_id, start, stop, {new} AS new, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev FROM {spans}),
{name}_p AS (SELECT r.doc_id, count(*) AS n, max(stop) AS last, string_agg(substr(d.text, prev + 1, start - prev) || new, '' ORDER BY start) AS head FROM {name}_r r JOIN {docs} d USING (doc_id) GROUP BY r.doc_id),
{name} AS (SELECT d.doc_id, d.text, coalesce(n, 0)::INT AS n, CASE WHEN n IS NULL THEN d.text ELSE head || substr(d.text, last + 1) END AS out FROM {docs} d LEFT JOIN {name}_p USING (doc_id))"""


_COUNTS = "counts AS (SELECT doc_id, count(*)::INT AS n_detected, (count(*) FILTER (decision = 'MASK'))::INT AS n_masked FROM decided GROUP BY doc_id)"
_NO_NAMES = ("email", "phone", "inn", "card", "citizenship", "department_code")
_DOCUMENT_SPANS = f"""s AS ({o._out('EMAIL', '0.95', o._found('documents', o._EMAIL))} UNION ALL {o._CARD_DOCUMENTS} UNION ALL {o._INN_DOCUMENTS}),
e AS (SELECT doc_id, type, lower(trim(value)) AS k, min(start) AS first, arg_min(value, start) AS original FROM s GROUP BY ALL),
n AS (SELECT *, CASE type WHEN 'CARD_NUMBER' THEN 'CARD' ELSE type END || '_' || row_number() OVER (PARTITION BY doc_id, type ORDER BY first) AS id FROM e),
t AS (SELECT s.doc_id, s.start, s."end" AS stop, '<' || id || '>' AS token, original FROM s JOIN n ON n.doc_id = s.doc_id AND n.type = s.type AND n.k = lower(trim(s.value)))"""

FLOWS: dict[str, str] = {
    "d19_names": f"""WITH {o.RU} SELECT doc_id, surface AS value, (instr(text, surface) - 1)::INT AS start, (instr(text, surface) - 1 + length(surface))::INT AS "end", confidence::DOUBLE AS confidence, gram_case, gender,
      nominal AS nominal_form, alias AS alias_type, known AS known_public_figure FROM ({_NAMED})""",
    "e01_people": f"""WITH RECURSIVE {decided(('fio',))}, {ENTITIES}
      SELECT doc_id, 'person:' || lower(k) || '#1' AS key, count(*) AS mentions, split_part(k, '|', 1) AS surname, split_part(k, '|', 2) AS first, split_part(k, '|', 3) AS patronymic FROM m GROUP BY doc_id, k""",
    "x06_decisions": f"""WITH RECURSIVE {decided()} SELECT doc_id, type, value, start, stop AS "end", round(confidence, 2) AS confidence, decision, array_to_string(reasons, ',') AS reasons FROM decided""",
    "p01_decisions_structured": f"""WITH RECURSIVE {decided(('card', 'pin', 'address'))} SELECT doc_id, type, start, decision, round(sure, 2) AS confidence, array_to_string(reasons, ',') AS reasons FROM decided""",
    "r05_partial_mask_all": f"""WITH RECURSIVE {decided()}, {_COUNTS}, masked AS (SELECT * FROM decided WHERE decision = 'MASK'), {spliced('masked', PARTIAL)}
      SELECT doc_id, out AS masked_text, coalesce(n_detected, 0)::INT AS n_detected, coalesce(n_masked, 0)::INT AS n_masked, true AS restored_exactly FROM done LEFT JOIN counts USING (doc_id)""",
    "m02_token_round_trip": f"""WITH RECURSIVE {decided(_NO_NAMES)}, {ENTITIES}, {spliced('tok', 'token')}, {spliced('tok', 'original', name='back')}
      SELECT doc_id, done.out AS masked_text, done.text AS exact, back.out AS restored FROM done JOIN back USING (doc_id)""",
    "s02_inspect": f"""WITH RECURSIVE {decided()}, {_COUNTS}, {ENTITIES}, {spliced('tok', 'token')}, {spliced('tok', 'original', name='back')}
      SELECT doc_id, coalesce(n_detected, 0)::INT AS n_detected, coalesce(n_masked, 0)::INT AS n_masked, done.out AS masked_text, back.out AS demasked, back.out = done.text AS round_trip_ok,
      coalesce(ents, 0)::INT AS n_mappings FROM done JOIN back USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS ents FROM num GROUP BY doc_id) USING (doc_id)""",
    "s02_inspect_consumers": f"""WITH RECURSIVE {decided().replace("decided AS (", "judged_all AS (")},
      asked AS (SELECT doc_id, text, ['token', 'partial', 'bogus', 'token', 'partial'][doc_id % 5 + 1] AS mode, [NULL, 'chat-assistant', 'analytics-pipeline', 'nobody'][(doc_id // 20) % 4 + 1] AS consumer FROM ru),
      said AS (SELECT *, CASE WHEN mode = 'bogus' THEN 'invalid_mode' WHEN consumer = 'nobody' THEN 'unknown_consumer' ELSE '' END AS error FROM asked),
      barred AS (SELECT j.*, mode, error, decision = 'MASK' AND coalesce(consumer = 'chat-assistant', false) AND type NOT IN ('FULL_NAME', 'PHONE', 'EMAIL', 'PASSPORT', 'CARD_NUMBER', 'CVV', 'PIN') AS excluded FROM judged_all j JOIN said USING (doc_id)),
      decided AS (SELECT * REPLACE (CASE WHEN excluded THEN 'KEEP' ELSE decision END AS decision) FROM barred WHERE error = ''),
      {_COUNTS}, {ENTITIES}, both_modes AS (SELECT tok.*, CASE WHEN mode = 'token' THEN token ELSE {PARTIAL} END AS new, CASE WHEN mode = 'token' THEN original ELSE {PARTIAL} END AS old FROM tok JOIN said USING (doc_id)),
      {spliced('both_modes', 'new')}, {spliced('both_modes', 'old', name='back')},
      kinds AS (SELECT doc_id, string_agg(type, ',' ORDER BY start) AS excluded FROM decided WHERE excluded GROUP BY doc_id)
      SELECT doc_id, mode, CASE error WHEN 'invalid_mode' THEN 422 WHEN 'unknown_consumer' THEN 404 ELSE 200 END AS status, error, CASE WHEN error = '' THEN done.out ELSE '' END AS masked_text,
      CASE WHEN error <> '' THEN '' ELSE back.out END AS demasked, CASE WHEN error = '' AND mode = 'token' THEN (back.out = done.text)::VARCHAR ELSE '' END AS round_trip_ok,
      CASE WHEN error <> '' THEN -1 ELSE coalesce(n_detected, 0) END AS n_detected, CASE WHEN error <> '' THEN -1 ELSE coalesce(n_masked, 0) END AS n_masked, coalesce(excluded, '') AS excluded
      FROM said JOIN done USING (doc_id) JOIN back USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN kinds USING (doc_id)""",
    "t01_process_directions": f"""WITH {_DOCUMENT_SPANS}, {spliced('t', 'token', 'documents')}, {spliced('t', 'original', 'documents', 'back')},
      q AS (SELECT doc_id, doc_id % 4 AS k, done.text, done.out AS masked, back.out AS content FROM done JOIN back USING (doc_id))
      SELECT CASE WHEN k = 3 THEN 'new' ELSE '' END || doc_id AS payload_id, CASE WHEN k = 3 THEN 'mask' WHEN k = 0 OR k = 1 AND masked = text THEN 'retry_mask' ELSE 'demask' END AS direction,
      sha256(CASE WHEN k = 0 THEN masked WHEN k = 1 THEN text WHEN k = 2 THEN 'Re: ' || content ELSE 'Re: ' || masked END) AS result FROM q""",
    "t02_process_batch": f"""WITH masked AS ({o._FLAGSHIP}),
      d AS (SELECT doc_id AS k, text, masked_text FROM documents JOIN masked USING (doc_id)),
      q AS (SELECT k, CASE WHEN k % 7 = 0 THEN '' ELSE k::VARCHAR END AS id, text AS payload, 2 * k AS seq FROM d
        UNION ALL SELECT k, k::VARCHAR, CASE WHEN k % 3 = 0 THEN text ELSE 'another' END, 2 * k + 1 FROM d WHERE k % 3 < 2),
      s AS (SELECT *, CASE WHEN id = '' THEN 422 WHEN length(payload) > 3000 THEN 413 WHEN k % 5 = 0 THEN 403 ELSE 200 END AS st FROM q),
      f AS (SELECT *, first_value(payload) OVER (PARTITION BY id, st ORDER BY seq) AS won FROM s),
      a AS (SELECT k, id, seq, CASE WHEN st <> 200 THEN st WHEN payload = won THEN 200 ELSE 409 END AS status, CASE WHEN won = 'another' THEN won ELSE masked_text END AS made FROM f JOIN d USING (k))
      SELECT id AS payload_id, seq, CASE WHEN status IN (200, 409) THEN 'mask' ELSE '' END AS direction, status, sha256(CASE WHEN status = 200 THEN made ELSE '' END) AS result FROM a""",
    "s06_vault_stream": """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS payload_id, event_id AS seq, ts, event_type IN ('purchase', 'signup') AS saves, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
      f AS (SELECT payload_id, i, CASE WHEN saves THEN seq END AS seq, CASE WHEN saves THEN 'ACTIVE' END AS state, CASE WHEN saves THEN ts + INTERVAL 3 DAY END AS expires, NULL::TIMESTAMP AS demasked FROM e WHERE i = 1
        UNION ALL SELECT e.payload_id, e.i, CASE WHEN renew THEN e.seq ELSE f.seq END, CASE WHEN renew THEN 'ACTIVE' WHEN turn THEN 'DEMASKED_GRACE' ELSE f.state END,
          CASE WHEN renew THEN ts + INTERVAL 3 DAY WHEN turn THEN ts + INTERVAL 6 HOUR ELSE f.expires END, CASE WHEN renew THEN NULL WHEN turn THEN ts ELSE f.demasked END
        FROM (SELECT e.*, e.saves AND (f.expires IS NULL OR f.expires <= ts) AS renew, NOT e.saves AND f.expires > ts AND f.state = 'ACTIVE' AS turn FROM f JOIN e ON e.payload_id = f.payload_id AND e.i = f.i + 1) e
        JOIN f ON e.payload_id = f.payload_id AND e.i = f.i + 1),
      l AS (SELECT payload_id, max(i) AS i FROM f GROUP BY payload_id)
      SELECT payload_id, seq, state, 'token' AS mode, strftime(expires, '%Y-%m-%d %H:%M:%S.%f') AS expires_at, coalesce(strftime(demasked, '%Y-%m-%d %H:%M:%S.%f'), '') AS demasked_at
      FROM f JOIN l USING (payload_id, i) WHERE expires > (SELECT max(ts) FROM events)""",
    "x01_sentence_windows": f"""SELECT doc_id, start, (start - length(regexp_extract(substr(text, greatest(start - 220, 0) + 1, start - greatest(start - 220, 0)), '[^.!?\\n]*$')))::INT AS low,
      (start + length(value) + length(regexp_extract(substr(text, start + length(value) + 1, 220), '^[^.!?\\n]*[.!?\\n]?')))::INT AS high FROM ({o._found('documents', '[0-9]+')})""",
}


# --- the compact profile: radii in bytes, by hexadecimal digits ---


def _near_bytes(kind: str) -> str:
    radius, words = cp.NEAR[kind]
    start, end = "strlen(substr(text, 1, start))", "strlen(substr(text, 1, start + length(value)))"
    low = f"greatest({start} - {radius}, 0)"
    window = f"substr(hex(encode(lower(text))), 2 * {low} + 1, 2 * ({end} + {radius} - {low}))"
    return "(" + " OR ".join(f"contains({window}, '{w.encode().hex().upper()}')" for w in words) + ")"


def _compact(kind: str, pattern: str, where: str = "true", value: str = "value") -> str:
    return f"""SELECT doc_id, text, {kind} AS type, {value} AS value, start, (start + length({value}))::INT AS "end" FROM ({o._found('ru', pattern)}) WHERE {where}"""


_P = {k: p.replace(r"\d", "[0-9]") for k, p in cp.PATTERNS.items()}
_FENCE = o._fenced()
_CODE = f"CASE WHEN {_near_bytes('CVV')} THEN 'CVV' WHEN length(value) = 4 AND {_near_bytes('PIN')} THEN 'PIN' END"
_DATE = f"CASE WHEN {_near_bytes('BIRTH_DATE')} THEN 'BIRTH_DATE' WHEN {_near_bytes('PASSPORT_ISSUE_DATE')} THEN 'PASSPORT_ISSUE_DATE' END"
_LUHN = f"length({o._D}) BETWEEN 13 AND 19 AND {o._luhn(o._D)}"
_COMPACT = {
    "g03_compact_inn": _compact("'INN'", _P["inn"], f"{_FENCE} AND {o._inn('value')} AND {_near_bytes('INN')}"),
    "card": _compact("'CARD_NUMBER'", _P["card"], f"{_FENCE} AND {_LUHN}"),
    "g04_compact_codes": _compact(_CODE, _P["code"], f"{_FENCE} AND {_CODE} IS NOT NULL"),
    "g05_compact_dates": " UNION ALL ".join(_compact(_DATE, _P[k], f"{_FENCE} AND {_DATE} IS NOT NULL") for k in ("date", "date_iso", "date_text")),
    "g06_compact_address": " UNION ALL ".join([*[_compact("'ADDRESS'", _P[k]) for k in ("address_index", "address_words")], _compact("'ADDRESS'", _P["address_compact"], _near_bytes("ADDRESS"))]),
    "g07_compact_named": " UNION ALL ".join([
        _compact("'PASSPORT_ISSUER'", _P["issuer"], value="regexp_replace(value, '[ \\t.]+$', '')"), *[_compact("'CITIZENSHIP'", c, _near_bytes("CITIZENSHIP")) for c in cp.CITIZENSHIPS],
        _compact("'CARDHOLDER'", _P["cardholder"], _near_bytes("CARDHOLDER")),
    ]),
}
FLOWS |= {k: f'WITH {o.RU} SELECT doc_id, type, value, start, "end" FROM ({v})' for k, v in _COMPACT.items() if k != "card"}
_ANY = lambda words: "(" + " OR ".join(o._hit("w", w) for w in words) + ")"
FLOWS["g01_compact_decisions"] = f"""WITH RECURSIVE {o.RU}, cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, start - "end") AS i FROM ({' UNION ALL '.join(_COMPACT.values())})),
g AS (SELECT doc_id, i, "end" AS last, [i] AS acc FROM cand WHERE i = 1
  UNION ALL SELECT g.doc_id, c.i, CASE WHEN c.start >= last THEN c."end" ELSE last END, CASE WHEN c.start >= last THEN list_append(acc, c.i) ELSE acc END FROM g JOIN cand c ON c.doc_id = g.doc_id AND c.i = g.i + 1),
kept AS (SELECT doc_id, unnest(arg_max(acc, i)) AS i FROM g GROUP BY doc_id),
chosen AS (SELECT c.*, coalesce(lag("end") OVER w, 0) AS prev, coalesce(lead(start) OVER w, length(text)) AS next FROM cand c JOIN kept USING (doc_id, i) WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
b AS (SELECT *, greatest(prev, start - length(regexp_extract(substr(text, greatest(start - 220, 0) + 1, start - greatest(start - 220, 0)), '[^.!?\\n]*$'))) AS low,
  least(next, "end" + length(regexp_extract(substr(text, "end" + 1, 220), '^[^.!?\\n]*[.!?\\n]?'))) AS high FROM chosen),
w AS (SELECT *, lower(substr(text, low + 1, high - low)) AS w FROM b),
r AS (SELECT *, CASE WHEN type = 'ADDRESS' THEN CASE WHEN {_ANY(cp.PERSONAL_ADDRESS)} THEN 'personal_address' WHEN {_ANY(cp.ORGANIZATION_ADDRESS)} THEN 'organizational_address' ELSE 'no_context_fail_safe' END
  WHEN type = 'PIN' AND NOT EXISTS (SELECT 1 FROM w c WHERE c.doc_id = w.doc_id AND c.type = 'CARD_NUMBER'
    AND strlen(substr(w.text, least(w.start, c.start) + 1, CASE WHEN w.start < c.start THEN c."end" ELSE w."end" END - least(w.start, c.start))) <= {cp.PIN_EXTENT}
    AND NOT contains(substr(w.text, least(w.start, c.start) + 1, CASE WHEN w.start < c.start THEN c."end" ELSE w."end" END - least(w.start, c.start)), chr(10) || chr(10))) THEN 'relationship_rule_unmet:CARD_NUMBER'
  ELSE 'personal_by_construction' END AS reason FROM w)
SELECT doc_id, type, start, "end", CASE WHEN reason IN ('organizational_address', 'relationship_rule_unmet:CARD_NUMBER') THEN 'KEEP' ELSE 'MASK' END AS decision, reason,
  CASE type WHEN 'CARDHOLDER' THEN array_to_string(list_transform(regexp_split_to_array(trim(value), '\\s+'), lambda w: upper(regexp_extract(w, '\\p{{L}}')) || '.'), ' ')
  WHEN 'CARD_NUMBER' THEN {_digits(4, 4, True)} WHEN 'INN' THEN {_digits(2, 2, True)} ELSE regexp_replace(value, '[\\p{{L}}\\p{{N}}]', '*', 'g') END AS partial FROM r"""


# --- the compact profile's names, surrogates and restoring ---

from ..sources import names_corpus as nc  # noqa: E402
from . import oracles_surrogates as osr  # noqa: E402


def _all(words: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _with_end(word: str, ends: list[str]) -> str:
    return f"list_filter({_all(ends)}, lambda e: ends_with({word}, e) AND length({word}) > length(e) + 1)"


def _bases(word: str, ends: list[str]) -> str:
    return f"list_transform({_with_end(word, ends)}, lambda e: left({word}, length({word}) - length(e)))"


_GIVEN = {w: g for g, words in cp.GIVEN.items() for w in words} | {w: "masc" for w in cp.OBLIQUE}
_LISTED = lambda b: f"list_filter(list_transform({_all(cp.TAILS)}, lambda t: {b} || t), lambda x: list_contains({_all(tuple(_GIVEN))}, x))"
_STEM = lambda b, ends: f"len(list_filter({_all(ends)}, lambda e: ends_with({b}, e))) > 0"
_NOMINAL = f"CASE WHEN len({_LISTED('b')}) > 0 THEN {_LISTED('b')}[1] WHEN len({_with_end('b', cp.SURNAME_ENDS)}) > 0 OR len({_with_end('b', cp.PATRONYMIC_ENDS)}) > 0 OR {_STEM('b', cp.STEM_ENDS)} THEN b WHEN {_STEM('b', cp.ADJECTIVE_STEMS)} THEN b || 'ой' END"
_OF_WORD = f"""given(w, g) AS (VALUES {', '.join(f"('{w}', '{g}')" for w, g in _GIVEN.items())}),
heard AS (SELECT DISTINCT word, lower(word) AS lw FROM spoken_words),
classed AS (SELECT word, lw, coalesce(a.g, b.g) AS known, {_with_end('lw', cp.PATRONYMIC_ENDS)} AS patr, {_with_end('lw', cp.SURNAME_ENDS)} AS surn,
  CASE WHEN a.g IS NOT NULL THEN lw ELSE coalesce(list_filter(list_transform({_bases('lw', cp.NOMINAL_ENDS)}, lambda b: {_NOMINAL}), lambda x: x IS NOT NULL)[1], lw) END AS nominal
  FROM heard LEFT JOIN given a ON a.w = lw LEFT JOIN given b ON b.w = flatten(list_transform({_bases('lw', cp.GIVEN_ENDS)}, lambda x: {_LISTED('x')}))[1]),
letters AS (SELECT word, nominal, CASE WHEN known IS NOT NULL THEN 'N' WHEN len(patr) > 0 THEN 'P' WHEN len(surn) > 0 THEN 'S' ELSE '-' END AS letter,
  CASE WHEN known IS NOT NULL THEN known WHEN len(patr) > 0 THEN CASE WHEN contains(patr[1], 'вн') OR contains(patr[1], 'чн') THEN 'femn' ELSE 'masc' END WHEN len(surn) > 0 AND NOT ends_with(surn[1], 'а') AND NOT ends_with(surn[1], 'ая') THEN 'masc' END AS gender,
  len(surn) > 0 AS by_end FROM classed)"""
_LAYOUTS = {0: ("surname", "first", "patronymic"), 1: ("first", "patronymic", "surname"), 2: ("first", "surname"), 3: ("surname", "first"), 4: ("first", "patronymic"), 7: ("unlisted", "first", "patronymic")}
FLOWS["g08_compact_names"] = f"""WITH w AS ({nc.WORDS_SQL}), t AS (SELECT *, {nc.MENTION} AS value FROM w),
spoken_words AS ({' UNION ALL '.join(f"SELECT doc_id, {i} AS pos, {c} AS word FROM w WHERE layout = {k}" for k, cs in _LAYOUTS.items() for i, c in enumerate(cs))}
  UNION ALL SELECT doc_id, 0, CASE WHEN layout = 8 THEN unlisted ELSE surname END FROM w WHERE layout IN (5, 6, 8)), {_OF_WORD},
signs AS (SELECT doc_id, string_agg(CASE WHEN pos = 0 THEN '|' ELSE ' ' END || letter, '' ORDER BY pos) AS s, list(word ORDER BY pos) AS words, list(nominal ORDER BY pos) AS nominals, list(gender ORDER BY pos) AS genders
  FROM spoken_words JOIN letters USING (word) GROUP BY doc_id),
runs AS (SELECT doc_id, words, nominals, genders, regexp_extract(s, '{cp.NAME_RUN}') AS r, (instr(s, regexp_extract(s, '{cp.NAME_RUN}')) // 2)::INT AS i, (length(regexp_extract(s, '{cp.NAME_RUN}')) + 1) // 2 AS n FROM signs WHERE regexp_matches(s, '{cp.NAME_RUN}')),
found AS (SELECT t.doc_id, array_to_string(words[i:i + n - 1], ' ') AS v, length(prefix) + length(array_to_string(words[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS start, 'person:' || array_to_string(nominals[i:i + n - 1], ' ') AS identity_key,
    coalesce(list_filter(genders[i:i + n - 1], lambda g: g IS NOT NULL)[1], '') AS gender FROM runs JOIN t USING (doc_id) WHERE layout NOT IN (5, 6, 8)
  UNION ALL SELECT doc_id, value, length(prefix), 'person:' || nominal, '' FROM t JOIN letters ON word = CASE WHEN layout = 8 THEN unlisted ELSE surname END WHERE layout IN (5, 6, 8) AND by_end)
SELECT doc_id, v AS value, start::INT AS start, (start + length(v))::INT AS "end", identity_key, gender FROM found"""

_X = osr._x
_CITY_OF = lambda i: osr._pick(_all(fv.CITIES), i)
_SHORT = f"array_to_string(list_transform(string_split(original, ''), lambda c, i: CASE WHEN c >= '0' AND c <= '9' THEN (hs[{{0}} + len(regexp_replace(substr(original, 1, i), '[^0-9]', '', 'g'))] % 10)::VARCHAR ELSE c END), '')"
_BODY = f"('4' || {osr._digit_run(0, 14)})"
_COMPACT_VALUE = f"""CASE WHEN type = 'CARDHOLDER' THEN CASE WHEN len(string_split(original, ' ')) >= 3 THEN {osr._pick(_all(fv.MALE_LAST[:10]), 0)} || ' ' || {osr._pick(_all(fv.MALE_FIRST[:10]), 1)} || ' ' || {osr._pick(_all(fv.MALE_PATRONYMIC), 2)}
    ELSE {osr._pick(_all(fv.MALE_FIRST[:10]), 1)} || ' ' || {osr._pick(_all(fv.MALE_LAST[:10]), 0)} END
  WHEN type = 'INN' THEN CASE WHEN length(original) = 12 THEN {osr._INN_11} || {osr._weighted(osr._INN_11, fv.INN_12)} ELSE {osr._INN_10} END
  WHEN type = 'CARD_NUMBER' THEN number
  WHEN type IN ('BIRTH_DATE', 'PASSPORT_ISSUE_DATE') THEN lpad(({_X(0, 28)} + 1)::VARCHAR, 2, '0') || '.' || lpad(({_X(1, 12)} + 1)::VARCHAR, 2, '0') || '.' || ({_X(2, 55)} + 1950)::VARCHAR
  WHEN type = 'CITIZENSHIP' THEN {osr._pick(_all(("Россия", "Беларусь", "Казахстан", "Армения", "Узбекистан", "Грузия")), 0)}
  WHEN type = 'PASSPORT_ISSUER' THEN 'ГУ МВД России по г. ' || {_CITY_OF(0)}
  WHEN type = 'ADDRESS' THEN lpad(({_X(0, 599_999)} + 100000)::VARCHAR, 6, '0') || ', г. ' || {_CITY_OF(1)} || ', ул. ' || {osr._pick(_all(fv.STREETS), 2)} || ', д. ' || ({_X(3, 250)} + 1)::VARCHAR || ', кв. ' || ({_X(4, 500)} + 1)::VARCHAR
  WHEN type IN ('CVV', 'PIN') THEN CASE WHEN {_SHORT.format(0)} <> original THEN {_SHORT.format(0)} ELSE {_SHORT.format("length(original)")} END END"""
FLOWS["g12_compact_surrogates"] = f"""WITH RECURSIVE {o.RU}, picked AS ({FLOWS["g01_compact_decisions"].replace(f"WITH RECURSIVE {o.RU}, ", "WITH RECURSIVE ", 1)}),
c AS (SELECT p.doc_id, p.type, p.start, p."end" AS stop, substr(text, p.start + 1, p."end" - p.start) AS value, text, CASE p.type WHEN 'CARD_NUMBER' THEN 'CARD' ELSE p.type END AS prefix FROM picked p JOIN ru USING (doc_id) WHERE p.decision = 'MASK'),
e AS (SELECT doc_id, prefix, type, lower(trim(value)) AS k, min(start) AS first, arg_min(value, start) AS original FROM c GROUP BY ALL),
n AS (SELECT *, prefix || '_' || row_number() OVER (PARTITION BY doc_id, prefix ORDER BY first) AS entity_id FROM e),
seeds AS (SELECT *, ((('0x' || substr(sha256(doc_id::VARCHAR || ':' || type || ':' || k), 1, 16))::UBIGINT & 9223372036854775807) + attempt)::VARCHAR AS seed FROM n, (SELECT unnest(range(6)) AS attempt)),
drawn AS (SELECT *, list_transform(range({osr.DRAWS}), lambda i: ('0x' || substr(sha256(seed || ':' || i::VARCHAR), 1, 16))::UBIGINT) AS hs FROM seeds),
bodies AS (SELECT *, {_BODY} AS body FROM drawn), numbers AS (SELECT *, {osr._NUMBER} AS number FROM bodies),
tries AS (SELECT doc_id, entity_id, type, k, first, original, attempt, {_COMPACT_VALUE} AS v FROM numbers),
made AS (SELECT doc_id, entity_id, type, k, first, original, arg_min(v, attempt) AS synthetic FROM tries WHERE v <> original GROUP BY ALL),
spoken_words AS (SELECT value, unnest(string_split(value, ' ')) AS word FROM c WHERE type = 'CARDHOLDER'), {_OF_WORD},
oblique AS (SELECT DISTINCT value FROM spoken_words JOIN letters USING (word) WHERE length(word) > 2 AND nominal <> lower(word)),
said AS (SELECT c.doc_id, c.start, c.stop, CASE WHEN o.value IS NOT NULL THEN '<' || entity_id || '>' ELSE synthetic END AS new FROM c JOIN made m ON m.doc_id = c.doc_id AND m.type = c.type AND m.k = lower(trim(c.value)) LEFT JOIN oblique o ON c.type = 'CARDHOLDER' AND o.value = c.value), {spliced('said', 'new')},
pairs AS (SELECT doc_id, list_concat(list(struct_pack(n := '<' || entity_id || '>', o := original) ORDER BY first), list(struct_pack(n := regexp_replace(synthetic, '([.-])', '\\\\\\1', 'g'), o := original) ORDER BY first)) AS ps FROM made GROUP BY doc_id),
steps AS (SELECT doc_id, 0 AS i, 'Re: ' || out AS t, ps FROM done LEFT JOIN pairs USING (doc_id)
  UNION ALL SELECT doc_id, i + 1, CASE WHEN starts_with(ps[i + 1].n, '<') THEN replace(t, ps[i + 1].n, ps[i + 1].o)
    ELSE regexp_replace(t, CASE WHEN regexp_matches(ps[i + 1].n, '^[A-Za-z0-9_]') THEN '\\b' ELSE '' END || ps[i + 1].n || CASE WHEN regexp_matches(ps[i + 1].n, '[A-Za-z0-9_]$') THEN '\\b' ELSE '' END, ps[i + 1].o, 'g') END, ps FROM steps WHERE i < len(ps)),
told AS (SELECT doc_id, arg_max(t, i) AS restored FROM steps GROUP BY doc_id)
SELECT doc_id, out AS masked_text, restored FROM done JOIN told USING (doc_id)"""
