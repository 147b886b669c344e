"""SQL for DuckDB of names in all forms: the words of each text are rows, joined with the rows of the lexicon."""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..operators import morphology as m
from ..sources import names_corpus as nc

_READ = "read(word, role, gender, c, nominal, ord) AS (VALUES " + ", ".join(f"('{w}', '{r}', '{g}', {c}, '{n}', {i})" for w, r, g, c, n, i in nc.readings_rows()) + ")"
_CASES = "[" + ", ".join(f"'{c}'" for c in fv.CASES) + "]"
_PUBLIC = ", ".join(f"'{w}'" for w in fv.PUBLIC_SURNAMES)
#: The words of each layout, in order, with their roles.
_ORDERS = {0: "SNP", 1: "NPS", 2: "NS", 3: "SN", 4: "NP", 7: "UNP"}
_COLUMN = {"S": "surname", "N": "first", "P": "patronymic", "U": "unlisted"}
_WORDS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS pos, '{x.replace('U', 'S')}' AS role, {_COLUMN[x]} AS word FROM w WHERE layout = {k}" for k, order in _ORDERS.items() for i, x in enumerate(order)
)


def _open(order: str, field: str) -> str:
    """The readings of the word that decides a field: the first in the order of roles that has any."""
    rank = "CASE role " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(order)) + f" ELSE {len(order)} END"
    return f"""SELECT DISTINCT doc_id, {field} AS v FROM known QUALIFY dense_rank() OVER (PARTITION BY doc_id ORDER BY {rank}, pos) = 1"""


def _agreed(order: str, field: str, name: str) -> str:
    return f"""{name}_open AS ({_open(order, field)}),
{name}_votes AS (SELECT o.doc_id, v, count(DISTINCT pos) AS n FROM {name}_open o JOIN known k ON k.doc_id = o.doc_id AND k.{field} = o.v GROUP BY ALL),
{name} AS (SELECT doc_id, arg_min(v, (-n, CASE v::VARCHAR WHEN 'femn' THEN '1' WHEN 'masc' THEN '0' ELSE v::VARCHAR END)) AS v FROM {name}_votes GROUP BY doc_id)"""


N02 = f"""WITH {_READ},
w AS ({nc.WORDS_SQL}),
t AS (SELECT doc_id, layout, surname, unlisted, prefix, {nc.MENTION} AS value FROM w),
words AS ({_WORDS}),
known AS (SELECT words.*, gender, c, nominal, ord FROM words JOIN read USING (word, role)),
{_agreed('PN', 'gender', 'g')},
{_agreed('PSN', 'c', 'k')},
nominal AS (SELECT x.doc_id, x.pos, coalesce(arg_min(r.nominal, (r.gender <> g.v OR r.role <> x.role, r.gender <> g.v, r.ord)), x.word) AS n
  FROM words x JOIN g USING (doc_id) LEFT JOIN read r ON r.word = x.word GROUP BY x.doc_id, x.pos, x.word),
runs AS (SELECT t.doc_id, value, prefix, CASE WHEN layout IN (0, 1, 7) THEN 0.85 ELSE 0.75 END AS confidence, {_CASES}[k.v + 1] AS gram_case, g.v AS gender, string_agg(n, ' ' ORDER BY pos) AS nominal_form,
  CASE WHEN layout IN (0, 1, 7) THEN 'FULL' WHEN layout = 4 THEN 'NAME_PATRONYMIC' ELSE 'NAME_SURNAME' END AS alias_type
  FROM t JOIN nominal USING (doc_id) JOIN g USING (doc_id) JOIN k USING (doc_id) GROUP BY t.doc_id, value, prefix, layout, k.v, g.v),
short AS (SELECT doc_id, value, prefix, 0.7 AS confidence, {_CASES}[coalesce(arg_min(c, ord), 0) + 1] AS gram_case, coalesce(arg_min(gender, ord), '{m.MASC}') AS gender,
  coalesce(arg_min(nominal, ord), any_value(CASE WHEN layout = 8 THEN unlisted ELSE surname END)) AS nominal_form, 'SURNAME_INITIALS' AS alias_type
  FROM t LEFT JOIN read ON word = surname AND layout < 8 WHERE layout IN (5, 6, 8) GROUP BY doc_id, value, prefix),
found AS (SELECT * FROM runs UNION ALL SELECT * FROM short)
SELECT doc_id, value, length(prefix)::INT AS start, (length(prefix) + length(value))::INT AS "end", confidence::DOUBLE AS confidence, gram_case, gender, nominal_form, alias_type,
  len(list_filter(string_split(lower(nominal_form), ' '), lambda x: x IN ({_PUBLIC}))) > 0 AS known_public_figure FROM found"""
