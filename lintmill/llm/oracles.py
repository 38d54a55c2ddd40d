"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

WORD_GAP = r"[\x20\x09-\x0D]"


def crc32(text: str) -> str:
    """crc32 of ASCII text, a bit at a time; the polynomial is the one of zlib."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))"
    step = "CASE WHEN xor(crc, b) & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda crc, b: {step}), 4294967295)"


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Product codes: rounds of nearest entries and floors of means."""
    square = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - e.v[i]) * (x.v[i] - e.v[i])))::BIGINT"
    found = [f"""kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), cut AS MATERIALIZED (
        SELECT vec_id, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS v
        FROM kept, (SELECT unnest(range({parts})) AS p)
    ), e0 AS MATERIALIZED (
        SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM cut
        QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}
    )"""]
    for n in range(rounds + 1):
        found.append(f"""a{n} AS MATERIALIZED (
            SELECT x.vec_id, x.p, min({{'d': {square}, 'e': e.e}}) AS near FROM cut x JOIN e{n} e ON x.p = e.p GROUP BY x.vec_id, x.p
        )""")
        if n < rounds:
            found.append(f"""m{n} AS (
                SELECT p, e, list(mean ORDER BY i) AS v FROM (
                    SELECT p, e, i, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS mean FROM (
                        SELECT p, near.e AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n
                        FROM a{n} JOIN cut USING (vec_id, p), unnest(range(1, len(v) + 1)) AS t(i) GROUP BY p, near.e, i))
                GROUP BY p, e
            ), e{n + 1} AS MATERIALIZED (
                SELECT o.p, o.e, coalesce(m.v, o.v) AS v FROM e{n} o LEFT JOIN m{n} m ON o.p = m.p AND o.e = m.e
            )""")
    return f"""WITH {', '.join(found)}, coded AS (
        SELECT vec_id, string_agg(format('{{:02x}}', near.e), '' ORDER BY p) AS code, sum(near.d)::BIGINT AS error
        FROM a{rounds} GROUP BY vec_id
    ), books AS (
        SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM e{rounds}
    )
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id), books"""


WARC = """WITH held AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
    ), firsts AS (
        SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first_id FROM held
    )
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM firsts"""


def _links() -> str:
    """Sets of five-word shingles, links by counted shingles, components as reachable documents."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), sets AS MATERIALIZED (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM docs
    ), shingles AS MATERIALIZED (
        SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
    ), links AS MATERIALIZED (
        SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
    ), reached AS (
        SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
    )
    SELECT s.doc_id, len(s.s) AS n_shingles, least_id AS component_id
    FROM sets s JOIN (SELECT doc_id, min(other) AS least_id FROM reached GROUP BY doc_id) USING (doc_id)"""


def _repairs() -> str:
    """Conversation repair: a recursive search over rows, with (cost, script) of the four states in each."""
    of = lambda cost, script: f"{{'c': {cost}, 's': {script}}}"
    more = lambda state, cost, letter: of(f"{state}.c + {cost}", f"{state}.s || '{letter}'")
    never = of("1000000000", "''")
    twice = lambda q0, q1, q2, q3: (
        q0, q1, f"least({q2}, {more(q0, 3, 'I')}, {more(q1, 3, 'I')}, {more(q3, 3, 'I')})", f"least({q3}, {more(q2, 3, 'I')})")
    once = twice("q0", "q1", "q2", "q3")
    stay = lambda state, when, cost, letter: f"CASE WHEN {when} THEN {more(state, cost, letter)} ELSE {never} END"
    kept = "fault NOT IN ('b', 'd')"
    return f"""WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
        FROM keyed WHERE d <> 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
            regexp_replace(text, '{WORD_GAP}+$', '') AS said
        FROM damaged
    ), judged AS MATERIALIZED (
        SELECT *, left(role, 1) AS r, CASE WHEN said = '' THEN 'b' WHEN again > 1 THEN 'd'
            WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
        FROM placed
    ), step AS (
        SELECT conv_id, 0::BIGINT AS i, {of("0::BIGINT", "''")} AS q0, {of("1000000000::BIGINT", "''")} AS q1,
            {of("1000000000::BIGINT", "''")} AS q2, {of("1000000000::BIGINT", "''")} AS q3
        FROM (SELECT DISTINCT conv_id FROM judged)
        UNION ALL
        SELECT conv_id, i, {more("q0", 4, "D")},
            least({more("q1", 4, "D")}, {stay("q0", f"{kept} AND r = 's'", "extra", "K")}),
            least({more("q2", 4, "D")}, {', '.join(stay(q, f"{kept} AND r = 'u'", "extra", "K") for q in ("q0", "q1", "q3"))},
                {', '.join(stay(q, kept, "3 + extra", "R") for q in ("q0", "q1", "q3"))}),
            least({more("q3", 4, "D")}, {stay("q2", f"{kept} AND r = 'a'", "extra", "K")}, {stay("q2", kept, "3 + extra", "R")})
        FROM (
            SELECT conv_id, i, fault, r, extra, q0, q1, {once[2]} AS q2, {once[3]} AS q3
            FROM (
                SELECT s.conv_id, j.i, j.fault, j.r, CASE WHEN j.fault = 't' THEN 3 ELSE 0 END AS extra,
                    s.q0, s.q1, {', '.join(f"{c} AS {q}" for q, c in zip(("q2", "q3"), twice("s.q0", "s.q1", "s.q2", "s.q3")[2:]))}
                FROM step s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = s.i + 1))
    ), won AS (
        SELECT conv_id, least(q0, {more("q1", 6, "II")}, {more("q2", 3, "I")}, q3) AS best
        FROM step QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
    ), letters AS (
        SELECT conv_id, unnest(string_split(best.s, '')) AS letter, unnest(range(1, length(best.s) + 1)) AS k,
            length(replace(best.s, 'D', '')) AS size
        FROM won WHERE best.s <> ''
    ), traced AS (
        SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o
        FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)
    ), mended AS (
        SELECT t.conv_id, string_agg(CASE WHEN letter = 'K' THEN j.role
            WHEN (o - size % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE j.text END,
            chr(10) ORDER BY k) AS text
        FROM traced t LEFT JOIN judged j ON t.conv_id IS NOT DISTINCT FROM j.conv_id AND t.i = j.i
        WHERE letter <> 'D' GROUP BY t.conv_id
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
            count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
            count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY conv_id
    )
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
        coalesce(best.s, '') AS audit, sha256(coalesce(m.text, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
    LEFT JOIN won w ON c.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN mended m ON c.conv_id IS NOT DISTINCT FROM m.conv_id"""


def _chats() -> str:
    """Chat formatting: lengths of escaped turns, digests of the plain ones."""
    from lintmill.llm.chat_format import END, MIDDLE, OTHERS, START
    from lintmill.llm.queries import CONTROL

    def escaped(column: str) -> str:
        out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
        for control in [START, MIDDLE, END, *OTHERS]:
            out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
        return out

    reply = "FILTER (role = 'assistant')"
    return f"""SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
        coalesce(sum(length(coalesce(text, ''))) {reply}, 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn NULLS FIRST) {reply}, '')) AS loss_sha256,
        sum({len(START + MIDDLE + END)} + length({escaped("role")}) + length({escaped("text")}))::BIGINT AS formatted_chars,
        count(*) {reply} AS n_examples
    FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')) GROUP BY conv_id"""


ORACLE: dict[str, str] = {
    "op1_warc": WARC,
    "op5_ngram_jaccard_join": _links(),
    "op11_vector_codes": _codes(),
    "op12_conversation_repair": _repairs(),
    "op13_chat_format": _chats(),
}
