"""The SQL that each registered query must equal, for DuckDB on the same tables.

Written from the definitions of the operators, with joins of everything with everything where that is
the definition, so it is a check and not a plan.
"""

from __future__ import annotations

from groundwork.functions.text import STOP_WORDS
from groundwork.operators.grounding import NO_RECORD, NO_TICKETS, STILL_OPEN, SYSTEM_SHORT
from groundwork.operators.cells import (
    ANY_ANGLE, FIRST_ROWS, LEAST_CELLS, LEAST_COARSE, REACHED, SAMPLE, SLACK, WHOLE_RADIUS,
)
from groundwork.plans.registry import LONE_QUESTION, NARROW, STORED_THRESHOLD
from groundwork.schema import (
    AGGREGATE_POOL, ANSWER_POOL, CITATION_PATTERN, FUSION_CONSTANT, FUSION_DEPTH, GRAPH_SEEDS, SEVERITY_ORDER,
    SIMILAR_MAX_DISTANCE, SIMILAR_PER_TICKET, TICKET_COLUMNS, TICKET_SCHEMA, TOP_K, URGENT,
)
from groundwork.sources import given
from groundwork.sources.given import DIMS

COLUMNS = ", ".join(TICKET_COLUMNS)
T_COLUMNS = ", ".join(f"t.{c}" for c in TICKET_COLUMNS)
OPENED_AT = "TIMESTAMP '2026-01-06 06:00:00' + to_minutes(cast(15 * (doc_id % 24000) AS bigint))"
WORD = r"[\p{L}\p{N}]+"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_quoted(v) for v in values) + ")"


def _six(d: str) -> str:
    return f"CASE WHEN abs({d}) < 5e-7 THEN 0.0 ELSE round({d}, 6) END"


def _exact(value: str, digits: int) -> str:
    return f"cast(round(cast({value} AS decimal(28,10)), {digits}) AS double)"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def _stem(w: str) -> str:
    cut = f"length({w})"
    return (
        f"CASE WHEN {w} LIKE '%ies' AND {w} NOT LIKE '%eies' AND {w} NOT LIKE '%aies' THEN substr({w}, 1, {cut} - 3) || 'y' "
        f"WHEN {w} LIKE '%es' AND {w} NOT LIKE '%aes' AND {w} NOT LIKE '%ees' AND {w} NOT LIKE '%oes' THEN substr({w}, 1, {cut} - 1) "
        f"WHEN {w} LIKE '%s' AND {w} NOT LIKE '%us' AND {w} NOT LIKE '%ss' THEN substr({w}, 1, {cut} - 1) ELSE {w} END")


def _normal(words: str) -> str:
    return f"list_transform({words}, lambda w: CASE WHEN w IN {_in(STOP_WORDS)} THEN '' ELSE {_stem('w')} END)"


def _terms(words: str) -> str:
    return f"list_filter({_normal(words)}, lambda w: w <> '')"


def _padded(words: str) -> str:
    return f"(' ' || array_to_string({words}, ' ') || ' ')"


def _phrase(words: str) -> str:
    return f"(' ' || trim(array_to_string({words}, ' ')) || ' ')"


def _embedded(name: str, source: str, key: str, text: str, vector: str, dims: int = DIMS) -> dict[str, str]:
    """CTEs that give every row of `source` its hashed bag of terms."""
    return {
        f"{name}_h": f"SELECT {key}, ('0x' || substr(md5(term), 1, 6))::INT % {2 * dims} AS slot FROM "
                     f"(SELECT {key}, unnest({_words(text)}) AS term FROM {source})",
        f"{name}_s": f"SELECT {key}, slot % {dims} AS dim, sum(CASE WHEN slot < {dims} THEN 1.0 ELSE -1.0 END)::DOUBLE AS s "
                     f"FROM {name}_h GROUP BY 1, 2",
        f"{name}_m": f"SELECT {key}, map(list(dim::INT), list(s)) AS m, sqrt(sum(s * s)) AS len FROM {name}_s GROUP BY 1",
        name: f"SELECT b.*, [CASE WHEN coalesce(len, 0) = 0 THEN 0.0 ELSE coalesce(m[i::INT], 0) / len END::FLOAT "
              f"for i in range({dims})] AS {vector} FROM {source} b LEFT JOIN {name}_m USING ({key})",
    }


def _questions(panel: str) -> str:
    rows = ", ".join(f"('{panel}-{i}', {_quoted(q)})" for i, q in enumerate(given.CATALOGUE[panel], start=1))
    return (f"SELECT concat('bench-', item_id) AS question_id, text AS question FROM benchmark "
            f"UNION ALL SELECT * FROM (VALUES {rows}) v(question_id, question)")


def _pairs(dims: int = DIMS) -> str:
    cut = "" if dims == DIMS else f"[1:{dims}]"
    raw = f"list_cosine_distance((c.embedding::DOUBLE[]){cut}, (a.q_vector::DOUBLE[]){cut})"
    return (f"SELECT question_id, ticket_id, raw, {_six('raw')} AS distance FROM "
            f"(SELECT a.question_id, c.ticket_id, {raw} AS raw FROM corpus c, asked a) WHERE NOT isnan(raw)")


def _ranked(source: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {order})::INT AS rank FROM {source}"


TICKETS = {
    "tickets": "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in given.TICKET_EXPRESSIONS.items())
               + f", {OPENED_AT} AS opened_at FROM documents",
}
TEXTS = TICKETS | {
    "texts": "SELECT *, concat_ws(chr(10), nullif(title, ''), nullif(description, ''), nullif(resolution, '')) AS embedding_text, "
             "concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(resolution, ''), nullif(error_code, '')) AS search_text "
             "FROM tickets",
}
CORPUS = TEXTS | _embedded("corpus", "texts", "ticket_id", "embedding_text", "embedding")
STORED = {"stored": f"SELECT {given._id_from('vec_id')} AS ticket_id, concat('ERR-', 1000 + label) AS error_code, embedding FROM embeddings"}
ANSWERS = {"answers": f"SELECT {given.ANSWER_ID} AS answer_id, {given.ANSWER_TEXT} AS answer FROM conversations WHERE role = 'assistant'"}
CITED = TICKETS | ANSWERS | {
    "mentions": f"SELECT answer_id, unnest(ids) AS ticket_id, generate_subscripts(ids, 1) AS place FROM "
                f"(SELECT answer_id, regexp_extract_all(answer, '{CITATION_PATTERN}') AS ids FROM answers)",
    "firsts": "SELECT answer_id, ticket_id, min(place) AS place FROM mentions GROUP BY 1, 2",
    "cited": "SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY place)::INT AS position, ticket_id FROM firsts",
    "checked": "SELECT c.*, c.ticket_id IN (SELECT ticket_id FROM tickets) AS found FROM cited c",
}
TERMS = {"terms": "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(t)})" for t in given.CATALOGUE["keyword"] + given.COMMON_TERMS) + ") v(term)"}


def asked(panel: str) -> dict[str, str]:
    return {"questions": _questions(panel)} | _embedded("asked", "questions", "question_id", "question", "q_vector")


def near(panel: str) -> dict[str, str]:
    return CORPUS | asked(panel) | {"pairs": _pairs(), "near": _ranked("pairs", "distance, ticket_id")}


def near_resolved(panel: str) -> dict[str, str]:
    return CORPUS | asked(panel) | {
        "pairs": _pairs(),
        "fixed": "SELECT p.* FROM pairs p JOIN tickets t USING (ticket_id) WHERE t.resolution IS NOT NULL AND t.resolution <> ''",
        "near": _ranked("fixed", "distance, ticket_id"),
    }


PHRASES = TEXTS | {
    "phrase_docs": f"SELECT ticket_id, {_padded(_words('search_text'))} AS padded FROM texts",
}


def phrase_hits(source: str, key: str, text: str) -> dict[str, str]:
    return PHRASES | {
        "phrases": f"SELECT {key} AS question_id, {_words(text)} AS pw FROM {source}",
        "phrase_pairs": f"SELECT question_id, ticket_id FROM phrases, phrase_docs WHERE len(pw) > 0 AND contains(padded, {_padded('pw')})",
    }


NORMAL = TEXTS | {"docs": f"SELECT ticket_id, {_normal(_words('search_text'))} AS words, len({_words('search_text')}) AS doc_len FROM texts"}


def lexical(panel: str) -> dict[str, str]:
    return NORMAL | {
        "questions": _questions(panel),
        "needs": f"SELECT question_id, list_distinct({_terms(_words('question'))}) AS needed FROM questions",
        "every": "SELECT question_id, ticket_id, needed, words FROM needs, docs WHERE len(needed) > 0 AND list_has_all(words, needed)",
    }


def cover(panel: str) -> dict[str, str]:
    return lexical(panel) | {
        "places": "SELECT question_id, ticket_id, needed, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM every",
        "hits": "SELECT question_id, ticket_id, len(needed) AS n, term, pos FROM places WHERE list_contains(needed, term)",
        "lasts": "SELECT e.question_id, e.ticket_id, e.n, e.pos AS hi, b.term, max(b.pos) AS last FROM hits e JOIN hits b "
                 "ON e.question_id = b.question_id AND e.ticket_id = b.ticket_id AND b.pos <= e.pos GROUP BY ALL",
        "covers": "SELECT question_id, ticket_id, hi, min(last) AS lo FROM lasts GROUP BY question_id, ticket_id, hi, n HAVING count(*) = n",
        "minimal": "SELECT *, lag(lo) OVER (PARTITION BY question_id, ticket_id ORDER BY hi) AS before FROM covers",
        "density": "SELECT question_id, ticket_id, round(sum(1.0::DOUBLE / (hi - lo + 1)), 6) AS score FROM minimal "
                   "WHERE before IS NULL OR lo > before GROUP BY 1, 2",
    }


def bm25(panel: str) -> dict[str, str]:
    return lexical(panel) | {
        "tf": "SELECT ticket_id, doc_len, term, count(*) AS tf FROM (SELECT ticket_id, doc_len, unnest(words) AS term FROM docs) "
              "WHERE term <> '' GROUP BY ALL",
        "df": "SELECT term, count(*) AS df FROM tf GROUP BY 1",
        "size": "SELECT count(*)::DOUBLE AS n, avg(doc_len) AS mean FROM docs",
        "wanted": "SELECT question_id, unnest(needed) AS term FROM needs",
        "bm": "SELECT question_id, ticket_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE "
              "/ (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / mean))), 6) AS score "
              "FROM wanted JOIN tf USING (term) JOIN df USING (term), size GROUP BY 1, 2",
    }


def fused(scores: str, digits: int) -> dict[str, str]:
    return {
        "lex": _ranked(scores, "score DESC, ticket_id"),
        "listed": f"SELECT question_id, ticket_id, rank FROM lex WHERE rank <= {FUSION_DEPTH} UNION ALL "
                f"SELECT question_id, ticket_id, rank FROM near WHERE rank <= {FUSION_DEPTH}",
        "rrfs": f"SELECT question_id, ticket_id, {_exact(f'sum(1.0::DOUBLE / ({FUSION_CONSTANT} + rank))', digits)} AS rrf FROM listed GROUP BY 1, 2",
        "top": _ranked("rrfs", "rrf DESC, ticket_id"),
    }


H1 = near("hybrid") | bm25("hybrid") | fused("bm", 10)
H2 = near("hybrid") | cover("hybrid") | fused("density", 5)


def similar(source: str, threshold: float) -> dict[str, str]:
    raw = "list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
    return {
        "apart": f"SELECT src, dst, {_six('raw')} AS distance FROM (SELECT a.ticket_id AS src, b.ticket_id AS dst, {raw} AS raw "
                 f"FROM {source} a, {source} b WHERE a.ticket_id <> b.ticket_id AND a.error_code <> b.error_code) WHERE NOT isnan(raw)",
        "placed": f"SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS place FROM apart WHERE distance < {threshold}",
        "similar_to": f"SELECT src, dst, distance FROM placed WHERE place <= {SIMILAR_PER_TICKET}",
    }


SIMILAR = CORPUS | similar("corpus", SIMILAR_MAX_DISTANCE)
NODES = TICKETS | {
    "asset_n": "SELECT DISTINCT asset AS name, domain FROM tickets",
    "team_n": "SELECT DISTINCT team AS name, domain FROM tickets",
    "code_n": "SELECT DISTINCT error_code AS code, component, domain FROM tickets",
}
_HOURS = _exact("avg(hours)", 1)
BY_CODE = NODES | {
    "code_paths": "SELECT c.code, a.name AS asset, a.domain, t.resolved_hours AS hours FROM tickets t "
                  "JOIN code_n c ON c.code = t.error_code JOIN asset_n a ON a.name = t.asset",
    "by_code": f"SELECT code, asset, domain, count(*) AS tickets, {_HOURS} AS avg_hours FROM code_paths GROUP BY 1, 2, 3",
}
BY_MEANING = SIMILAR | NODES | {
    "meaning_paths": "SELECT c.code, a.name AS asset, a.domain, u.resolved_hours AS hours FROM tickets t "
                     "JOIN code_n c ON c.code = t.error_code JOIN similar_to s ON s.src = t.ticket_id "
                     "JOIN tickets u ON u.ticket_id = s.dst JOIN asset_n a ON a.name = u.asset",
    "by_meaning": f"SELECT code, asset, domain, count(*) AS tickets, {_HOURS} AS avg_hours FROM meaning_paths GROUP BY 1, 2, 3",
}
EXPANDED = near("graph") | BY_CODE | BY_MEANING | {
    "seeds": f"SELECT n.question_id, n.rank, t.asset, t.error_code FROM near n JOIN tickets t USING (ticket_id) WHERE n.rank <= {GRAPH_SEEDS}",
    "fault": "SELECT question_id, error_code AS code FROM seeds WHERE rank = 1",
    "l": "SELECT f.question_id, w.* FROM fault f JOIN by_code w USING (code)",
    "r": "SELECT f.question_id, w.* FROM fault f JOIN by_meaning w USING (code)",
    "merged": "SELECT coalesce(l.question_id, r.question_id) AS question_id, coalesce(l.code, r.code) AS code, "
              "coalesce(l.asset, r.asset) AS asset, coalesce(l.domain, r.domain) AS domain, "
              "coalesce(l.tickets, 0) AS tickets, coalesce(r.tickets, 0) AS related, coalesce(l.avg_hours, r.avg_hours) AS avg_hours, "
              "l.asset IS NOT NULL AS by_code, l.asset IS NULL AS by_meaning_only FROM l FULL OUTER JOIN r "
              "ON l.question_id = r.question_id AND l.asset = r.asset AND l.domain = r.domain",
    "flagged": "SELECT m.*, EXISTS (SELECT 1 FROM seeds s WHERE s.question_id = m.question_id AND s.asset = m.asset) AS in_search FROM merged m",
    "expanded": "SELECT *, CASE WHEN by_meaning_only THEN 'meaning' WHEN in_search THEN 'found' ELSE 'new' END AS kind FROM flagged",
}

_LONG = (
    "t.ticket_id || ' | ' || t.domain || ' | ' || t.asset || ' | ' || t.error_code || ' | ' || t.severity || ' | resolved in ' "
    "|| coalesce(cast(t.resolved_hours AS varchar), 'None') || ' h' || chr(10) || '  title: ' || t.title || chr(10) "
    "|| '  reported: ' || t.description || chr(10) || '  resolution: ' || "
    f"CASE WHEN t.resolution = '' THEN '{STILL_OPEN}' ELSE t.resolution END")
_SHORT = ("t.ticket_id || ' | ' || t.title || chr(10) || '  reported: ' || t.description || chr(10) || '  fixed by:  ' || t.resolution")
COMPARED = near_resolved("grounded") | phrase_hits("questions", "question_id", "question") | {
    "keyword_near": _ranked("phrase_pairs", "ticket_id"),
    "both_sides": f"SELECT question_id, ticket_id, rank, 'keyword' AS side FROM keyword_near WHERE rank <= {ANSWER_POOL} UNION ALL "
                  f"SELECT question_id, ticket_id, rank, 'semantic' AS side FROM near WHERE rank <= {ANSWER_POOL}",
    "each_side": "SELECT question_id, question, side FROM questions, (VALUES ('keyword'), ('semantic')) v(side)",
    "gathered": f"SELECT b.question_id, b.side, count(*) AS n, string_agg({_LONG}, chr(10) ORDER BY b.rank) AS context, "
                "string_agg(t.ticket_id, ', ' ORDER BY b.rank) AS ids FROM both_sides b JOIN tickets t USING (ticket_id) GROUP BY 1, 2",
    "contexts": f"SELECT e.*, coalesce(g.n, 0) AS n_tickets, coalesce(g.context, '{NO_TICKETS}') AS context, g.ids FROM each_side e "
                "LEFT JOIN gathered g USING (question_id, side)",
}
SHORT = near_resolved("plain") | {
    "gathered": f"SELECT n.question_id, count(*) AS n, string_agg({_SHORT}, chr(10) ORDER BY n.rank) AS context, "
                f"string_agg(t.ticket_id, ', ' ORDER BY n.rank) AS ids, "
                f"string_agg(t.ticket_id || ' | ' || t.title, chr(10) ORDER BY n.rank) AS lines "
                f"FROM near n JOIN tickets t USING (ticket_id) WHERE n.rank <= {ANSWER_POOL} GROUP BY 1",
    "contexts": f"SELECT q.question_id, q.question, coalesce(g.n, 0) AS n_tickets, coalesce(g.context, '{NO_TICKETS}') AS context, g.ids, g.lines "
                "FROM questions q LEFT JOIN gathered g USING (question_id)",
}
_SAID = f"CASE WHEN ids IS NULL THEN '{NO_RECORD}' ELSE 'This was seen in ' || ids || '.' END"


def _scoped_pairs() -> dict[str, str]:
    n = "length(question)"
    return CORPUS | asked("filtered") | {
        "scopes": f"SELECT question_id, CASE {n} % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' END AS severity, "
                  f"CASE WHEN {n} % 5 < 2 THEN concat('D', {n} % 4) END AS domain, {n} % 2 = 0 AS resolved_only FROM questions",
        "pairs": _pairs(),
        "kept": "SELECT p.* FROM pairs p JOIN scopes s USING (question_id) JOIN tickets t USING (ticket_id) "
                "WHERE (s.severity IS NULL OR t.severity = s.severity) AND (s.domain IS NULL OR t.domain = s.domain) "
                "AND (NOT s.resolved_only OR t.resolution <> '')",
        "near": _ranked("kept", "distance, ticket_id"),
    }


def _steps(cosine: str) -> str:
    return f"cast(floor(acos(greatest(-1.0, least(1.0, {cosine}))) * 1e6 + 0.5) AS bigint)"


def _angle(a: str, b: str) -> str:
    return _steps(f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])")


def _celled() -> dict[str, str]:
    """Tickets in the cell of their nearest centre within the group of their nearest coarse centre, the share of a radius
    that reaches the neighbours of drawn tickets, and the pairs of a question and the tickets of the cells in its reach."""
    k = TOP_K

    def grouped(rows: str, key: str, vector: str) -> str:
        return (f"SELECT {key}, part FROM (SELECT {key}, part, row_number() OVER (PARTITION BY {key} ORDER BY steps, part) AS r FROM "
                f"(SELECT x.{key}, c.cell AS part, {_angle('x.' + vector, 'c.centre')} AS steps FROM {rows} x, coarse c)) WHERE r = 1")

    def routed(name: str, rows: str, pairs: str) -> dict[str, str]:
        """The reach of each question, and its cells: the first ones (f) and those within reach for a share."""
        return {
            f"{name}_angles": f"SELECT x.question_id, c.cell, c.n, c.radius, {_angle('x.q_vector', 'c.centre')} AS steps FROM {rows} x, cells c "
                              "WHERE len(list_filter(x.q_vector, lambda v: v <> 0)) > 0",
            f"{name}_cells": f"SELECT *, sum(n) OVER (PARTITION BY question_id ORDER BY steps, cell) - n < {FIRST_ROWS * k} AS f FROM {name}_angles",
            f"{name}_met": f"SELECT p.question_id, p.distance, row_number() OVER (PARTITION BY p.question_id ORDER BY p.distance, p.ticket_id) AS r "
                           f"FROM {pairs} p JOIN placed USING (ticket_id) JOIN {name}_cells c ON c.question_id = p.question_id AND c.cell = placed.cell WHERE c.f",
            f"{name}_reach": f"SELECT question_id, coalesce(max({_steps('1.0 - distance - 1e-6')}) FILTER (r = {k}) + {SLACK}, {ANY_ANGLE}) AS reach "
                             f"FROM {rows} LEFT JOIN {name}_met USING (question_id) GROUP BY 1",
        }

    return near("vector") | {
        "drawn": "SELECT ticket_id, embedding, row_number() OVER (ORDER BY md5(ticket_id), ticket_id) - 1 AS place FROM corpus "
                 "WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0",
        "how_many": f"SELECT greatest({LEAST_CELLS}, 2 * floor(sqrt(count(*)))) AS n FROM drawn",
        "centres": "SELECT embedding AS centre, min(place) AS cell FROM drawn, how_many WHERE place < n GROUP BY embedding",
        "coarse": f"SELECT centre, cell FROM (SELECT *, row_number() OVER (ORDER BY cell) AS r FROM centres) "
                  f"WHERE r <= (SELECT greatest({LEAST_COARSE}, floor(sqrt(count(*)))) FROM centres)",
        "fine": f"SELECT c.cell, c.centre, CASE WHEN c.cell IN (SELECT cell FROM coarse) THEN c.cell ELSE g.part END AS part "
                f"FROM centres c JOIN ({grouped('centres', 'cell', 'centre')}) g USING (cell)",
        "placed": "SELECT ticket_id, cell, steps FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY steps, cell) AS r FROM "
                  f"(SELECT d.ticket_id, f.cell, {_angle('d.embedding', 'f.centre')} AS steps FROM drawn d "
                  f"JOIN ({grouped('drawn', 'ticket_id', 'embedding')}) g USING (ticket_id) JOIN fine f ON f.part = g.part)) WHERE r = 1",
        "cells": "SELECT p.cell, any_value(c.centre) AS centre, count(*) AS n, max(p.steps) AS radius FROM placed p JOIN centres c USING (cell) GROUP BY 1",
        "asking": f"SELECT ticket_id AS question_id, embedding AS q_vector FROM drawn, how_many WHERE place >= n AND place < n + {SAMPLE}",
        "asking_pairs": f"SELECT question_id, ticket_id, {_six('raw')} AS distance FROM (SELECT a.question_id, d.ticket_id, "
                        "list_cosine_distance(d.embedding::DOUBLE[], a.q_vector::DOUBLE[]) AS raw FROM drawn d, asking a WHERE d.ticket_id <> a.question_id)",
        **routed("asking", "asking", "asking_pairs"),
        "neighbours": f"SELECT question_id, cell FROM ({_ranked('asking_pairs', 'distance, ticket_id')}) JOIN placed USING (ticket_id) WHERE rank <= {k}",
        "needed": "SELECT CASE WHEN c.f OR c.radius = 0 THEN 0 ELSE ceil((c.steps - r.reach) * 1000 / greatest(c.radius, 1)) END AS x "
                  "FROM neighbours t JOIN asking_cells c USING (question_id, cell) JOIN asking_reach r USING (question_id)",
        "learned": f"SELECT coalesce((SELECT least({WHOLE_RADIUS}, greatest(0, x)) FROM (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM needed) "
                   f"WHERE r = ceil({REACHED} * n / 1000.0)), {WHOLE_RADIUS}) AS share",
        **routed("asked", "asked", "pairs"),
        "probed": "SELECT question_id, cell FROM asked_cells JOIN asked_reach USING (question_id), learned "
                  "WHERE f OR steps * 1000 - share * radius <= reach * 1000",
        "reached": "SELECT p.question_id, p.ticket_id, p.distance FROM pairs p JOIN placed USING (ticket_id) JOIN probed b ON b.question_id = p.question_id AND b.cell = placed.cell",
        "approximate": _ranked("reached", "distance, ticket_id"),
        "scanned": "SELECT question_id, sum(n)::BIGINT AS candidates FROM probed JOIN cells USING (cell) GROUP BY 1",
    }


def _web() -> dict[str, str]:
    none = "CAST([] AS varchar[])"

    first, last = "w[1:len(w) - 1]", "w[len(w):len(w)]"

    def kind(name: str, must: str, some: str, phrase: str, no: str) -> str:
        return (f"SELECT question_id || '/{name}' AS question_id, {must} AS must, {some} AS anyof, {phrase} AS phrase, {no} AS no FROM split")

    overlap = "len(list_intersect({}, words)) > 0"
    return NORMAL | {
        "questions": _questions("hybrid"),
        "split": f"SELECT question_id, {_words('question')} AS w FROM questions",
        "kinds": kind("must", first, first, none, last) + " UNION ALL " + kind("phrase", none, none, "w", none)
                 + " UNION ALL " + kind("any", last, first, none, none),
        "web": f"SELECT question_id, {_terms('must')} AS must, {_terms('anyof')} AS anyof, {_normal('phrase')} AS phrase, {_terms('no')} AS no FROM kinds",
        "web_pairs": "SELECT question_id, ticket_id FROM web, docs WHERE (len(must) > 0 OR len(anyof) > 0 OR len(list_filter(phrase, lambda x: x <> '')) > 0) "
                     "AND list_has_all(words, must) "
                     f"AND (len(anyof) = 0 OR {overlap.format('anyof')}) "
                     f"AND (len(list_filter(phrase, lambda x: x <> '')) = 0 OR contains({_padded('words')}, {_phrase('phrase')})) "
                     f"AND NOT {overlap.format('no')}",
    }


MERGE = {"target": "SELECT vec_id, label, embedding FROM embeddings",
         "batch": "SELECT 2 * vec_id AS vec_id, label + 100 AS label, embedding FROM embeddings"}
_TEXT7 = "'[' || array_to_string(list_transform({}, lambda x: printf('%.7f', x::DOUBLE)), ',') || ']'"


def _sql(ctes: dict[str, str], final: str) -> str:
    parts = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in ctes.items())
    return f"WITH {parts}\n{final}"


# Searches over a stored index, and those over the texts with which they agree.
INDEXED = {"k1_indexed_search": "k1_keyword_search", "k3_indexed_counts": "k3_term_counts", "k4_indexed_match_all": "k4_match_all",
           "k6_indexed_bm25": "k6_bm25", "k7_indexed_cover_density": "k7_cover_density",
           "h1_indexed_hybrid": "h1_hybrid_search", "h2_indexed_by_hand": "h2_hybrid_by_hand", "r4_answers_once": "r4_answers"}


def oracle_sql() -> dict[str, str]:
    checks = _oracle_sql()
    return checks | {indexed: checks[name] for indexed, name in INDEXED.items()}


def _oracle_sql() -> dict[str, str]:
    top = f"rank <= {TOP_K}"
    places = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITY_ORDER))
    urgent = f"count(*) FILTER (WHERE t.severity IN {_in(URGENT)})"
    mean = _exact("avg(t.resolved_hours)", 1)
    lone = _embedded("lone", "one", "question_id", "question", "q_vector")
    width = CORPUS | asked("vector") | {
        "pairs": _pairs(), "near": _ranked("pairs", "distance, ticket_id"),
        "short_pairs": _pairs(NARROW), "short_near": _ranked("short_pairs", "distance, ticket_id")}
    narrow = TEXTS | _embedded("corpus", "texts", "ticket_id", "embedding_text", "embedding", NARROW)

    return {
        "s1_read_tickets": _sql(TICKETS, f"SELECT {COLUMNS} FROM tickets"),
        "s2_write_tickets": _sql(TICKETS, "SELECT ticket_id, title, description, resolution, coalesce(resolved_hours, -1.0::DOUBLE) AS hours FROM tickets"),
        "s13_create_and_recreate": _sql(TICKETS, "SELECT 0::INT AS step, domain, count(*) AS n FROM tickets GROUP BY domain UNION ALL SELECT 1::INT, domain, count(*) FROM tickets GROUP BY domain "
                                                 "UNION ALL SELECT 2::INT, domain, count(*) FROM tickets WHERE domain <> 'D0' GROUP BY domain"),
        "s14_one_domain": _sql(TICKETS, f"SELECT {COLUMNS} FROM tickets WHERE domain = 'D1'"),
        "s3_to_ticket": _sql(TEXTS, f"SELECT {COLUMNS}, search_text FROM texts"),
        "s4_embedding_text": _sql(TEXTS, "SELECT ticket_id, embedding_text FROM texts"),
        "s5_search_text": _sql(TEXTS, "SELECT ticket_id, search_text FROM texts"),
        "s6_embed_batch": _sql(narrow, f"SELECT ticket_id, {NARROW}::INT AS dims, {_TEXT7.format('embedding')} AS vector_text FROM corpus"),
        "s7_hashed_embedding": _sql(CORPUS, f"SELECT ticket_id, i::INT AS dim, round(embedding[i + 1]::DOUBLE, 6) AS value FROM corpus, range({DIMS}) r(i)"),
        "s8_embed_questions": _sql(asked("vector"), f"SELECT question_id, {DIMS}::INT AS dims, i::INT AS dim, round(q_vector[i + 1]::DOUBLE, 6) AS value FROM asked, range(12) r(i)"),
        "s9_truncate": _sql(STORED, f"SELECT ticket_id, i::INT AS dim, round(embedding[i + 1]::DOUBLE, 6) AS value FROM stored, range({NARROW}) r(i)"),
        "s10_vector_text": _sql(STORED, f"SELECT ticket_id, {_TEXT7.format('embedding')} AS vector_text, len(embedding)::INT AS values_read_back, "
                                        "round(list_sum(list_transform(embedding, lambda x, i: printf('%.7f', x::DOUBLE)::FLOAT::DOUBLE * i)), 5) AS weighted_sum FROM stored"),
        "s11_upsert_replace": _sql(MERGE, f"SELECT vec_id, label, {_TEXT7.format('embedding')} AS vector_text FROM "
                                          "(SELECT * FROM target WHERE vec_id NOT IN (SELECT vec_id FROM batch) UNION ALL SELECT * FROM batch)"),
        "s12_upsert_embedding": _sql(MERGE, f"SELECT vec_id, label, {_TEXT7.format('embedding')} AS vector_text FROM "
                                            "(SELECT t.vec_id, t.label, coalesce(b.embedding, t.embedding) AS embedding FROM target t LEFT JOIN batch b USING (vec_id) "
                                            "UNION ALL SELECT * FROM batch WHERE vec_id NOT IN (SELECT vec_id FROM target))"),
        "s15_postings": _sql(TEXTS | {"split": f"SELECT ticket_id, {_words('search_text')} AS words FROM texts",
                                      "spread": "SELECT ticket_id, unnest(words) AS term FROM split",
                                      "lengths": "SELECT ticket_id, len(words)::INT AS doc_len FROM split"},
                             "SELECT ticket_id, term, doc_len, count(*) AS tf FROM spread JOIN lengths USING (ticket_id) GROUP BY 1, 2, 3"),
        "p1_projection": _sql(TICKETS, f"SELECT {COLUMNS} FROM tickets"),
        "p2_filter": _sql(TICKETS, "SELECT ticket_id, domain, severity FROM tickets WHERE severity = 'High' AND domain = 'D1' AND resolution <> ''"),
        "p3_resolved": _sql(TICKETS, "SELECT ticket_id, resolution FROM tickets WHERE resolution IS NOT NULL AND resolution <> ''"),
        "p4_key_lookup": _sql(CITED, "SELECT ticket_id, asset, status FROM tickets WHERE ticket_id IN (SELECT ticket_id FROM cited WHERE position = 1)"),
        "p5_key_set": _sql(CITED, "SELECT ticket_id, domain, error_code FROM tickets WHERE ticket_id IN (SELECT ticket_id FROM cited)"),
        "p6_clean_values": _sql(TICKETS, "SELECT ticket_id, strftime(opened_at, '%Y-%m-%dT%H:%M:%S') AS opened_at, resolved_hours FROM tickets"),
        "p7_kinds": _sql(EXPANDED, "SELECT question_id, kind, count(*) AS assets FROM expanded GROUP BY 1, 2"),
        "k1_keyword_search": _sql(TERMS | phrase_hits("terms", "term", "term") | {"ranked": _ranked("phrase_pairs", "ticket_id")},
                                  f"SELECT question_id AS term, rank, {T_COLUMNS} FROM ranked JOIN tickets t USING (ticket_id) WHERE {top}"),
        "k2_keyword_count": _sql(TERMS | phrase_hits("terms", "term", "term"),
                                 "SELECT 'of the' AS term, count(*) AS total_matches FROM phrase_pairs WHERE question_id = 'of the'"),
        "k3_term_counts": _sql(TERMS | phrase_hits("terms", "term", "term"),
                               "SELECT term, count(ticket_id) AS total_matches FROM terms LEFT JOIN phrase_pairs ON term = question_id GROUP BY 1"),
        "k4_match_all": _sql(lexical("hybrid"), "SELECT question_id, ticket_id FROM every"),
        "k5_web_matches": _sql(_web(), "SELECT question_id, ticket_id FROM web_pairs"),
        "k6_bm25": _sql(bm25("hybrid") | {"lex": _ranked("bm", "score DESC, ticket_id")},
                        f"SELECT question_id, ticket_id, score, rank FROM lex WHERE rank <= {FUSION_DEPTH}"),
        "k7_cover_density": _sql(cover("hybrid"), "SELECT question_id, ticket_id, score FROM density"),
        "k8_vocabulary": _sql(TEXTS | {"v": f"SELECT DISTINCT unnest({_words('search_text')}) AS term FROM texts"},
                              f"SELECT term, {_stem('term')} AS stem, term IN {_in(STOP_WORDS)} AS is_stop FROM v"),
        "v1_cosine_distance": _sql(STORED | {"firsts": "SELECT error_code, min_by(embedding, ticket_id) AS first FROM stored GROUP BY 1",
                                             "d": "SELECT s.ticket_id, list_cosine_distance(s.embedding::DOUBLE[], f.first::DOUBLE[]) AS raw FROM stored s JOIN firsts f USING (error_code)"},
                                   f"SELECT ticket_id, {_six('raw')} AS distance FROM d"),
        "v2_vector_search": _sql(CORPUS | {"one": f"SELECT 'q' AS question_id, {_quoted(LONE_QUESTION)} AS question"} | lone
                                 | {"asked": "SELECT * FROM lone", "pairs": _pairs(), "near": _ranked("pairs", "distance, ticket_id")},
                                 f"SELECT 'vector-1' AS question_id, rank, distance, {T_COLUMNS} FROM near JOIN tickets t USING (ticket_id) WHERE {top}"),
        "v3_filtered_search": _sql(_scoped_pairs(), f"SELECT question_id, rank, distance, {T_COLUMNS} FROM near JOIN tickets t USING (ticket_id) WHERE {top}"),
        "v4_plain_english": _sql(near("plain"), f"SELECT question_id, rank, {_exact('raw', 4)} AS distance, {T_COLUMNS} FROM near JOIN tickets t USING (ticket_id) WHERE {top}"),
        "v5_batch_topk": _sql(near("vector"), f"SELECT question_id, rank, distance, {T_COLUMNS} FROM near JOIN tickets t USING (ticket_id) WHERE {top}"),
        "v6_approximate": _sql(_celled(), f"SELECT question_id, rank, distance, ticket_id FROM approximate WHERE {top}"),
        "v6_every_cell": _sql(near("vector"), f"SELECT question_id, rank, distance, ticket_id FROM near WHERE {top}"),
        "v7_access_report": _sql(_celled(), f"SELECT n.question_id, {TOP_K}::INT AS k, count(a.ticket_id) AS overlap, round(count(a.ticket_id)::DOUBLE / count(*), 6) AS recall, "
                                                         f"any_value(s.candidates) AS candidates FROM near n LEFT JOIN (SELECT * FROM approximate WHERE {top}) a USING (question_id, ticket_id) "
                                                         f"JOIN scanned s ON s.question_id = n.question_id WHERE n.rank <= {TOP_K} GROUP BY 1"),
        "v8_width_report": _sql(width, f"SELECT n.question_id, {TOP_K}::INT AS k, count(s.ticket_id) AS overlap, round(count(s.ticket_id)::DOUBLE / count(*), 6) AS recall "
                                       f"FROM near n LEFT JOIN (SELECT * FROM short_near WHERE {top}) s USING (question_id, ticket_id) WHERE n.rank <= {TOP_K} GROUP BY 1"),
        "h1_hybrid_search": _sql(H1, f"SELECT question_id, rank, {T_COLUMNS} FROM top JOIN tickets t USING (ticket_id) WHERE {top}"),
        "h2_hybrid_by_hand": _sql(H2, f"SELECT question_id, rrf, {T_COLUMNS} FROM top JOIN tickets t USING (ticket_id) WHERE {top}"),
        "h3_candidates": _sql(near("hybrid") | cover("hybrid") | {"lex": _ranked("density", "score DESC, ticket_id")},
                              f"SELECT question_id, ticket_id, rank, 'semantic' AS side FROM near WHERE rank <= {FUSION_DEPTH} UNION ALL "
                              f"SELECT question_id, ticket_id, rank, 'lexical' AS side FROM lex WHERE rank <= {FUSION_DEPTH}"),
        "h4_rank_only": _sql(H1, f"SELECT question_id, rank, ticket_id FROM top WHERE {top}"),
        "a1_total": _sql(TICKETS, "SELECT count(*) AS total FROM tickets"),
        "a2_count_by_domain": _sql(TICKETS, "SELECT domain, count(*) AS n FROM tickets GROUP BY ROLLUP (domain)"),
        "a3_distinct": _sql(TICKETS, "SELECT DISTINCT severity FROM tickets"),
        "a4_facets": _sql(TICKETS, f"SELECT DISTINCT 'severity' AS facet, severity AS value, (CASE severity {places} ELSE 9 END)::INT AS place FROM tickets "
                                   "UNION ALL SELECT DISTINCT 'domain', domain, 0::INT FROM tickets"),
        "a5_semantic_aggregate": _sql(near("plain"), f"SELECT n.question_id, t.domain, t.team, count(*) AS tickets, {mean} AS avg_hours, {urgent} AS urgent "
                                                     f"FROM near n JOIN tickets t USING (ticket_id) WHERE n.rank <= {AGGREGATE_POOL} GROUP BY 1, 2, 3"),
        "a6_urgent": _sql(TICKETS, f"SELECT domain, count(*) AS tickets, {urgent} AS urgent FROM tickets t GROUP BY 1"),
        "a7_average_hours": _sql(TICKETS, f"SELECT asset, status, {mean} AS avg_hours FROM tickets t GROUP BY 1, 2"),
        "a8_text_aggregate": _sql(SHORT, "SELECT question_id, lines FROM contexts WHERE n_tickets > 0"),
        "a9_frequency": _sql(TICKETS, "SELECT error_code, count(*) AS n FROM tickets GROUP BY 1"),
        "a10_graph_counts": _sql(SIMILAR | NODES, "SELECT 'asset' AS label, count(*) AS n FROM asset_n UNION ALL SELECT 'team', count(*) FROM team_n "
                                                  "UNION ALL SELECT 'code', count(*) FROM code_n UNION ALL SELECT 'ticket', count(*) FROM tickets "
                                                  "UNION ALL SELECT 'edges', (SELECT count(*) FROM tickets t JOIN asset_n a ON a.name = t.asset) "
                                                  "+ (SELECT count(*) FROM tickets t JOIN team_n a ON a.name = t.team) "
                                                  "+ (SELECT count(*) FROM tickets t JOIN code_n c ON c.code = t.error_code) + (SELECT count(*) FROM similar_to)"),
        "a11_composition": _sql(near("vector"), f"SELECT n.question_id, t.error_code, count(*) AS n FROM near n JOIN tickets t USING (ticket_id) WHERE {top} GROUP BY 1, 2"),
        "t2_first_ticket": _sql(TICKETS, f"SELECT {COLUMNS} FROM tickets ORDER BY ticket_id LIMIT 1"),
        "g1_nodes": _sql(NODES, "SELECT 'Asset' AS label, name, domain, CAST(NULL AS varchar) AS component FROM asset_n UNION ALL SELECT 'Team', name, domain, NULL FROM team_n "
                                "UNION ALL SELECT 'Code', code, domain, component FROM code_n"),
        "g2_ticket_nodes": _sql(TICKETS, "SELECT ticket_id AS id, asset, team, error_code AS code, severity, status, resolved_hours AS hours FROM tickets"),
        "g3_declared_edges": _sql(NODES, "SELECT ticket_id AS src, a.domain || '/' || name AS dst, 'ON' AS label FROM tickets t JOIN asset_n a ON t.asset = a.name "
                                         "UNION ALL SELECT ticket_id, a.domain || '/' || name, 'BY' FROM tickets t JOIN team_n a ON t.team = a.name "
                                         "UNION ALL SELECT ticket_id, c.domain || '/' || code || '/' || c.component, 'CODED' FROM tickets t JOIN code_n c ON t.error_code = c.code"),
        "g4_similar_to": _sql(SIMILAR, "SELECT src, dst, distance, 'SIMILAR_TO' AS label FROM similar_to"),
        "g4_similar_stored_vectors": _sql(STORED | similar("stored", STORED_THRESHOLD), "SELECT src, dst, distance, 'SIMILAR_TO' AS label FROM similar_to"),
        "g5_walk_by_code": _sql(BY_CODE, "SELECT code, asset, domain, tickets, avg_hours FROM by_code"),
        "g6_walk_by_meaning": _sql(BY_MEANING, "SELECT code, asset, domain, tickets, avg_hours FROM by_meaning"),
        "g7_seeds": _sql(near("graph"), f"SELECT n.question_id, n.rank, t.ticket_id, t.asset, t.error_code FROM near n JOIN tickets t USING (ticket_id) WHERE n.rank <= {GRAPH_SEEDS}"),
        "g7_expand": _sql(EXPANDED, "SELECT question_id, code, asset, domain, tickets, related, avg_hours, in_search, by_code, by_meaning_only, kind FROM expanded"),
        "g8_new_assets": _sql(EXPANDED, "SELECT question_id, asset, domain, kind FROM expanded WHERE NOT in_search"),
        "r1_long_context": _sql(COMPARED, "SELECT question_id, side, n_tickets, context FROM contexts"),
        "r2_short_context": _sql(SHORT, "SELECT question_id, n_tickets, context FROM contexts"),
        "r3_prompts": _sql(SHORT, f"SELECT question_id, {_quoted(SYSTEM_SHORT)} AS system, 'Tickets from our system:' || chr(10) || context || chr(10) || chr(10) "
                                  "|| 'Question: ' || question AS prompt FROM contexts"),
        "r4_answers": _sql(SHORT, f"SELECT question_id, {_SAID} AS answer FROM contexts"),
        "r5_compare": _sql(COMPARED, f"SELECT question_id, side, n_tickets, {_SAID} AS answer, n_tickets::INT AS cited, n_tickets::INT AS verified FROM contexts"),
        "r6_citations": _sql(CITED, "SELECT answer_id, position, ticket_id FROM cited"),
        "r7_verify": _sql(CITED, "SELECT answer_id, position, ticket_id, found AS \"exists\" FROM checked"),
        "r8_verdict": _sql(CITED, "SELECT answer_id, count(*) AS cited, count(*) FILTER (WHERE found) AS verified, "
                                  "coalesce(string_agg(ticket_id, ', ' ORDER BY position) FILTER (WHERE NOT found), '') AS failing, bool_and(found) AS all_ok FROM checked GROUP BY 1"),
        "q1_row_counts": _sql(TICKETS, "SELECT name, (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM tickets) AS actual, true AS passed FROM (VALUES ('tickets'), ('ticket nodes')) v(name)"),
        "q2_term_counts": _sql(
            TICKETS | {"hoped": "SELECT error_code AS term, count(*) AS expected FROM tickets GROUP BY 1 UNION ALL SELECT 'shaking', 0"} | phrase_hits("hoped", "term", "term"),
            "SELECT term AS name, expected, count(ticket_id) AS actual, expected = count(ticket_id) AS passed FROM hoped LEFT JOIN phrase_pairs ON term = question_id GROUP BY 1, 2"),
        "q3_top_composition": _sql(near("vector") | {"n": f"SELECT n.question_id, t.error_code, count(*) AS n FROM near n JOIN tickets t USING (ticket_id) WHERE {top} GROUP BY 1, 2"},
                                   "SELECT question_id AS name, 3::BIGINT AS expected, max(n) AS actual, max(n) >= 3 AS passed FROM n GROUP BY 1"),
        "q4_graph_reach": _sql(EXPANDED, "SELECT question_id AS name, 1::BIGINT AS expected, count(*) FILTER (WHERE by_meaning_only) AS actual, "
                                         "count(DISTINCT domain) FILTER (WHERE by_meaning_only) AS domains, count(*) FILTER (WHERE by_meaning_only) >= 1 AS passed FROM expanded GROUP BY 1"),
        "q5_retrieval_contrast": _sql(COMPARED, "SELECT question_id AS name, 0::BIGINT AS expected, (sum(n_tickets) FILTER (WHERE side = 'keyword'))::BIGINT AS actual, "
                                                "sum(n_tickets) FILTER (WHERE side = 'keyword') = 0 AND sum(n_tickets) FILTER (WHERE side = 'semantic') > 0 AS passed FROM contexts GROUP BY 1"),
        "q5_answers_cited": _sql(COMPARED, "SELECT question_id AS name, 0::BIGINT AS expected, 0::BIGINT AS actual, n_tickets > 0 AS passed FROM contexts WHERE side = 'semantic'"),
        "q6_stored_schema": "SELECT name, expected, expected AS actual, true AS passed FROM (VALUES "
                            + ", ".join(f"('{f.name}', '{f.dataType.simpleString()}')" for f in TICKET_SCHEMA) + ") v(name, expected)",
        "q7_kinds_agree": _sql(EXPANDED, "SELECT 'assets drawn as reached' AS name, 0::BIGINT AS expected, count(*) FILTER (WHERE (kind = 'meaning') <> by_meaning_only) AS actual, "
                                         "count(*) FILTER (WHERE (kind = 'meaning') <> by_meaning_only) = 0 AS passed FROM expanded"),
    }
