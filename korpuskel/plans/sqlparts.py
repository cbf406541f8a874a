"""Pieces of DuckDB SQL that several modules of queries share."""

from __future__ import annotations

from korpuskel.functions import text as X


def t(column: str) -> str:
    """An identifier in upper case without outer blanks; null if nothing is left."""
    return f"nullif(upper(trim({column}, E' \\t\\n')), '')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(column: str) -> str:
    return f"replace(lower({column}), 'ß', 'ss')"


def words(column: str) -> str:
    return f"regexp_extract_all({fold(column)}, {q(X.WORD)})"


def tokens(column: str) -> str:
    return f"flatten([CASE WHEN strip_accents(w) <> w THEN [w, strip_accents(w)] ELSE [w] END FOR w IN {words(column)}])"


def view(column: str) -> str:
    return f"trim(regexp_replace({column}, '{X.WHITE}', ' ', 'g'), ' ')"


def present(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({column}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


def latest(table: str, keys: str, order: str) -> str:
    return f"SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC) = 1"


def cells(source: str, keys: str) -> str:
    """CTEs up to ``cells`` (keys, cell, col, n, row_no, value) of the texts ``content_exact`` of ``source``, which are unique by ``keys``."""
    return f"""c_rows AS (SELECT {keys}, content_exact FROM {source} WHERE regexp_matches(content_exact, '^[A-Z]{{1,3}}[0-9]+=')),
c_lines AS (SELECT {keys}, content_exact, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split(content_exact, chr(10)) AS l FROM c_rows)),
c_parsed AS (SELECT *, regexp_extract(line, '^([A-Z]{{1,3}})[0-9]+=', 1) AS col, regexp_extract(line, '^[A-Z]{{1,3}}([0-9]+)=', 1) AS row_no, regexp_extract(content_exact, '^[A-Z]{{1,3}}([0-9]+)=', 1) AS own_row FROM c_lines),
c_numbered AS (SELECT *, CASE WHEN col <> '' AND row_no = own_row THEN list_sum([(ascii(substr(col, k, 1)) - 64) * CAST(26 ** (length(col) - k) AS BIGINT) FOR k IN range(1, length(col) + 1)]) END AS n FROM c_parsed),
c_opened AS (SELECT *, n IS NOT NULL AND n > coalesce(max(n) OVER w, 0) AS opens FROM c_numbered WINDOW w AS (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c_owned AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY {keys} ORDER BY i) AS cell FROM c_opened),
cells AS (
  SELECT {keys}, cell, max(col) FILTER (opens) AS col, max(n) FILTER (opens) AS n, max(row_no) FILTER (opens) AS row_no,
    string_agg(CASE WHEN opens THEN substr(line, length(col) + length(row_no) + 2) ELSE line END, chr(10) ORDER BY i) AS value
  FROM c_owned GROUP BY {keys}, cell)"""


def row_prints(keys: str) -> str:
    """CTE ``row_prints`` (keys, print) of ``cells``."""
    return f"row_prints AS (SELECT {keys}, sha256(string_agg(col || '=' || {fold(present('value'))} || chr(31), '' ORDER BY cell)) AS print FROM cells GROUP BY {keys})"


def placeholder(column: str) -> str:
    plain = f"lower(trim({column}, E' \\t\\n\\r'))"
    return f"({plain} IN ({', '.join(map(q, X.PLACEHOLDERS))}) OR starts_with({plain}, {q(X.PLACEHOLDER_START)}))"


Z = "1.959963984540054"


def wilson(n: str, k: str) -> tuple[str, str]:
    """Bounds of the Wilson interval, rounded to six places; 0 and 1 without trials."""
    return tuple(
        f"round(CASE WHEN {n} = 0 THEN {edge} ELSE {pick}({edge}, (({k} / {n} + {Z}^2 / (2 * {n})) {sign} {Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {Z}^2 / (4 * {n} * {n}))) / (1 + {Z}^2 / {n})) END, 6)"
        for edge, pick, sign in (("0.0", "greatest", "-"), ("1.0", "least", "+"))
    )
