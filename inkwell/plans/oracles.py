"""DuckDB SQL for the registered document queries that SQL can express."""

from __future__ import annotations

from inkwell.functions import ucd
from inkwell.operators import ledger, voice
from inkwell.plans import fixtures
from inkwell.plans import queries as q

_GLYPHS, _LATIN = "".join(ucd.CONFUSABLE), "".join(ucd.CONFUSABLE.values())
_PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
_ORDER = """CASE WHEN valid THEN 0 ELSE 1 END, CASE WHEN target_met THEN 0 ELSE 1 END, round(greatest(char_ratio, token_ratio), 6), round(drift, 6), round(risk, 6),
    model_calls, detector_queries, round(cost_usd, 6), content_hash"""
_COSTS = ("risk", "char_ratio", "token_ratio", "drift", "model_calls", "detector_queries", "cost_usd")


def _style(key: str) -> str:
    """Counts per text and measures per key; sentences are cut by a mark put at each break, as there is no look-behind."""
    w = voice.WORD
    cut = lambda t: f"string_split(regexp_replace(regexp_replace({t}, '([.!?])[\"'')\\]]*\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))"
    return f"""WITH t AS (SELECT {key}, trim(text, ' ') AS t FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> ''),
        c AS (SELECT {key}, t, regexp_extract_all(t, '{w.replace("'", "''")}') AS w,
              list_filter(list_transform({cut('t')}, lambda s: len(regexp_extract_all(s, '{w.replace("'", "''")}'))), lambda n: n > 0) AS s,
              len(list_filter(string_split(regexp_replace(t, '\\n\\s*\\n+', chr(1), 'g'), chr(1)), lambda p: regexp_matches(p, '[\\p{{L}}\\p{{N}}_]'))) AS p FROM t),
        g AS (SELECT {key}, count(*) AS n_texts, sum(len(w)) AS n_words, sum(len(s)) AS n_sentences, sum(p) AS n_paragraphs, sum(list_sum(s)) AS sum_len,
              sum(len(list_filter(s, lambda n: n <= 6))) AS n_short, sum(list_sum(list_transform(w, lambda x: length(x)))) AS word_chars,
              sum(length(t) - length(replace(t, ';', ''))) AS semis, sum(length(t) - length(replace(t, '!', ''))) AS marks FROM c GROUP BY {key})
        SELECT {key}, n_texts, CAST(n_words AS BIGINT) AS n_words, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(n_paragraphs AS BIGINT) AS n_paragraphs,
              sum_len / n_sentences AS mean_sentence_words, n_short / n_sentences AS short_ratio, word_chars / n_words AS mean_word_chars,
              semis * 1000.0::DOUBLE / n_words AS semicolon_rate, marks * 1000.0::DOUBLE / n_words AS exclamation_rate FROM g WHERE n_words >= 25"""


def _ngrams(text: str, n: int) -> str:
    w = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')"
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - {n - 1}, 0) + 1), lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), ' ')))"


def oracle_sql() -> dict[str, str]:
    marked, candidates = fixtures.inserted_sql(), fixtures.candidate_sql()
    found = q._findings_sql()
    # a clean text: removable characters dropped, odd spaces replaced; safe rows are told by their offsets
    clean = f"""WITH {found}, edits AS (SELECT doc_id, list("offset" ORDER BY "offset") AS at, list(replacement ORDER BY "offset") AS new, count(*) AS n_ops FROM findings WHERE removable GROUP BY doc_id),
        done AS (SELECT m.doc_id, m.text, coalesce(e.n_ops, 0) AS n_ops, CASE WHEN e.at IS NULL THEN m.text ELSE
            array_to_string(list_transform(range(length(m.text)), lambda i: CASE WHEN list_contains(e.at, CAST(i AS INTEGER)) THEN e.new[list_position(e.at, CAST(i AS INTEGER))] ELSE substr(m.text, i + 1, 1) END), '') END AS clean
            FROM marked m LEFT JOIN edits e USING (doc_id))"""
    spans = ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS {n}" for n, p in q.SPAN_PATTERNS.items())
    scripts = q._scripts_sql()
    better = " AND ".join(f"o.{c} <= c.{c}" for c in _COSTS), " OR ".join(f"o.{c} < c.{c}" for c in _COSTS)
    family = lambda c: f"CASE split_part(replace(lower(trim({c})), '_', '-'), '/', 1) " + " ".join(f"WHEN '{a}' THEN '{f}'" for a, f in ledger.PROVIDERS.items()) + f" ELSE split_part(replace(lower(trim({c})), '_', '-'), '/', 1) END"
    risk = lambda t: f"CAST(len(regexp_extract_all({t}, '(?:th|en|la)')) AS DOUBLE)"
    tokens = """SELECT doc_id, list(struct_pack(s := s, e := e) ORDER BY s) AS t, count(*) AS n FROM (
        SELECT doc_id, e - length(p) AS s, e, p FROM (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
            SELECT doc_id, unnest(regexp_extract_all(text, '\\s+|\\S+')) AS p, generate_subscripts(regexp_extract_all(text, '\\s+|\\S+'), 1) AS i FROM documents))
        WHERE regexp_matches(p, '^\\S')) GROUP BY doc_id"""
    windows = f"""tokens AS ({tokens}), windows AS (SELECT doc_id, t, n, unnest(range(CAST(greatest(ceil((n - 64) / 32.0), 0) AS BIGINT) + 1)) AS w FROM tokens),
        cut AS (SELECT doc_id, CAST(w AS INTEGER) AS "window", CAST(w * 32 AS INTEGER) AS token_start, CAST(least(w * 32 + 64, n) AS INTEGER) AS token_end,
            CAST(t[w * 32 + 1].s AS INTEGER) AS start, CAST(t[least(w * 32 + 64, n)].e AS INTEGER) AS "end" FROM windows)"""
    evidence = f"""tagged AS ({q._TAGGED}), evidence AS (
        SELECT page_id, 'unsigned_ai_metadata' AS kind, 'meta' AS place, '<meta name="x" content="Made with ChatGPT">' AS value FROM tagged WHERE html IS NOT NULL AND page_id % 4 = 1 AND contains(html, '<meta name="x"')
        UNION ALL SELECT page_id, 'unsigned_ai_metadata', 'json-ld', '<script type="application/ld+json">{{"digitalSource": 1}}</script>' FROM tagged WHERE page_id % 4 = 2 AND contains(html, 'application/ld+json')
        UNION ALL SELECT page_id, 'embedded_metadata', 'meta', '<meta name="generator" content="Site 1">' FROM tagged WHERE page_id % 4 = 0 AND contains(html, '<meta name="generator"'))"""
    names = "['Claude', 'openai/gpt', 'Ollama', 'meta_llama', 'mistral']"
    layers = "['" + "', '".join(ledger.LAYERS) + "']"
    options = """options AS (SELECT doc_id, text, unnest([struct_pack(a := 'the ', b := 'a '), struct_pack(a := 'der ', b := 'die '), struct_pack(a := 'de ', b := 'du '), struct_pack(a := ', ', b := '; ')]) AS o FROM documents),
        made AS (SELECT doc_id, text, instr(text, o.a) - 1 AS s, o.a AS a, o.b AS b, substr(text, 1, instr(text, o.a) - 1) || o.b || substr(text, instr(text, o.a) + length(o.a)) AS result FROM options WHERE instr(text, o.a) > 0)"""
    return {
        "doc_summary": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, chr(10), '')) + 1 ELSE 0 END AS INTEGER) AS n_lines, sha256(text) AS sha256 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        "line_offsets": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents),
            o AS (SELECT doc_id, i, n, p, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e FROM l)
            SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, CAST(e - length(p) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM o WHERE NOT (i = n AND p = '')""",
        "findings_rows": f"""WITH {found}, pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PIECES}')) AS p, generate_subscripts(regexp_extract_all(text, '{_PIECES}'), 1) AS i FROM marked WHERE regexp_matches(text, '[{_GLYPHS}]')),
            placed AS (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS s FROM pieces),
            letters AS (SELECT doc_id, s, p, unnest(range(length(p))) AS j FROM placed WHERE length(p) >= 2 AND regexp_matches(p, '[A-Za-z]') AND regexp_matches(p, '[{_GLYPHS}]')),
            both_kinds AS (SELECT doc_id, "offset", codepoint, kind, severity, removable, replacement FROM findings UNION ALL
                SELECT doc_id, CAST(s + j AS INTEGER), unicode(substr(p, j + 1, 1)), 'confusable', 'suspicious', false, CAST(NULL AS VARCHAR) FROM letters WHERE regexp_matches(substr(p, j + 1, 1), '[{_GLYPHS}]'))
            SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "offset", codepoint) - 1 AS INTEGER) AS number, "offset", codepoint, kind, severity, removable, replacement FROM both_kinds""",
        "findings_by_kind": f"WITH {found} SELECT kind, count(*) AS n, count(*) FILTER (removable AND replacement IS NOT NULL) AS n_removable FROM findings GROUP BY kind",
        "findings_rollup": f"WITH {found} SELECT source, lang, kind, count(*) AS n FROM findings GROUP BY ROLLUP (source, lang, kind)",
        "confusable_words": f"""WITH marked AS ({marked}), words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM marked WHERE regexp_matches(text, '[{_GLYPHS}]')),
            mixed AS (SELECT doc_id, word, unnest(string_split(word, '')) AS char FROM words WHERE length(word) >= 2 AND regexp_matches(word, '[A-Za-z]'))
            SELECT doc_id, word, char, translate(char, '{_GLYPHS}', '{_LATIN}') AS latin FROM mixed WHERE regexp_matches(char, '[{_GLYPHS}]')""",
        "doc_scripts": f"WITH {scripts} SELECT doc_id, array_to_string(s, ',') AS scripts FROM scripts",
        "script_histogram": f"WITH {scripts} SELECT script, count(*) AS n_docs FROM (SELECT unnest(s) AS script FROM scripts) GROUP BY script",
        "sanitize_safe": f"""{clean} SELECT doc_id, sha256(nfc_normalize(clean)) AS sha256, CAST(length(nfc_normalize(clean)) AS INTEGER) AS n_chars,
            CAST(n_ops + CASE WHEN doc_id % {len(fixtures.INSERTS)} = 14 THEN 1 ELSE 0 END AS INTEGER) AS n_ops,
            CASE WHEN doc_id % {len(fixtures.INSERTS)} = 14 THEN (n_ops + 2.0) / length(text) ELSE CAST(n_ops AS DOUBLE) / length(text) END AS edit_ratio FROM done""",
        "ops_apply": f"{clean} SELECT doc_id, sha256(clean) AS sha256, CAST(n_ops AS DOUBLE) / length(text) AS edit_ratio, abs(length(clean) - length(text)) / CAST(length(text) AS DOUBLE) AS drift FROM done WHERE n_ops > 0",
        "ops_invert_roundtrip": "SELECT count(*) AS n, count(*) AS n_same FROM documents",
        "span_counts": f"WITH marked AS ({marked}) SELECT source, {spans} FROM marked GROUP BY source",
        "select_min_edit": f"WITH c AS ({candidates}) SELECT doc_id, candidate_id, risk FROM c WHERE valid QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}, idx) = 1",
        "skyline": f"WITH c AS ({candidates}) SELECT doc_id, candidate_id FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND {better[0]} AND ({better[1]}))",
        "topk_regions": f"WITH c AS ({candidates}) SELECT doc_id, candidate_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY risk DESC, idx) AS INTEGER) AS rank FROM c QUALIFY rank <= 3",
        "dedup_by_hash": f"WITH c AS ({candidates}) SELECT doc_id, candidate_id FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY idx) = 1",
        "token_windows": f'WITH {windows} SELECT doc_id, "window", token_start, token_end, start, "end" FROM cut',
        "window_risk": f"""WITH {windows}, s AS (SELECT c.doc_id, c.start, c."end", {risk('substr(d.text, c.start + 1, c."end" - c.start)')} AS risk FROM cut c JOIN documents d USING (doc_id))
            SELECT doc_id, start, "end", risk, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY risk DESC, start, "end") AS INTEGER) AS rank FROM s QUALIFY rank <= 3""",
        "regions_merged": f"""WITH RECURSIVE tokens AS ({tokens}), windows AS (SELECT doc_id, t, n, unnest(range(CAST(greatest(ceil((n - 40) / 21.0), 0) AS BIGINT) + 1)) AS w FROM tokens),
            cut AS (SELECT doc_id, w AS k, t[w * 21 + 1].s AS s, t[least(w * 21 + 40, n)].e AS e, CAST(w % 7 AS DOUBLE) AS r FROM windows),
            f AS (SELECT doc_id, k, s, e, r, 0 AS g FROM cut WHERE k = 0
                UNION ALL SELECT c.doc_id, c.k, CASE WHEN least(f.e, c.e) - c.s >= 0.5 * least(f.e - f.s, c.e - c.s) THEN f.s ELSE c.s END,
                    CASE WHEN least(f.e, c.e) - c.s >= 0.5 * least(f.e - f.s, c.e - c.s) THEN greatest(f.e, c.e) ELSE c.e END,
                    CASE WHEN least(f.e, c.e) - c.s >= 0.5 * least(f.e - f.s, c.e - c.s) THEN greatest(f.r, c.r) ELSE c.r END,
                    CASE WHEN least(f.e, c.e) - c.s >= 0.5 * least(f.e - f.s, c.e - c.s) THEN f.g ELSE f.g + 1 END
                FROM f JOIN cut c ON c.doc_id = f.doc_id AND c.k = f.k + 1)
            SELECT doc_id, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS "end", max(r) AS risk FROM f GROUP BY doc_id, g""",
        "windows_clipped": f"""WITH {windows}, words AS (SELECT doc_id, s, coalesce(lead(e) OVER (PARTITION BY doc_id ORDER BY s), e) AS e, p FROM (SELECT doc_id, e - length(p) AS s, e, p FROM (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
                SELECT doc_id, unnest(regexp_extract_all(text, '\\s+|\\S+')) AS p, generate_subscripts(regexp_extract_all(text, '\\s+|\\S+'), 1) AS i FROM documents)) WHERE regexp_matches(p, '^\\S'))),
            held AS (SELECT doc_id, s, e FROM words WHERE regexp_matches(p, '^[A-Z]')),
            bounds AS (SELECT doc_id, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, s AS b FROM held
                UNION ALL SELECT d.doc_id, coalesce(max(h.e), 0), length(any_value(d.text)) FROM documents d LEFT JOIN held h USING (doc_id) GROUP BY d.doc_id)
            SELECT c.doc_id, CAST(greatest(c.start, b.a) AS INTEGER) AS start, CAST(least(c."end", b.b) AS INTEGER) AS "end", CAST(c."window" AS DOUBLE) AS risk
            FROM cut c JOIN bounds b ON b.doc_id = c.doc_id AND b.a < c."end" AND c.start < b.b WHERE greatest(c.start, b.a) < least(c."end", b.b)""",
        "edits_located": f"""WITH {found}, e AS (SELECT doc_id, text, "offset" AS s, "offset" + 1 AS e FROM findings WHERE removable UNION ALL SELECT doc_id, text, "offset" + 1, "offset" + 1 FROM findings WHERE removable),
            p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM marked),
            l AS (SELECT doc_id, i, n, p, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS b FROM p),
            lines AS (SELECT doc_id, i - 1 AS line, b - length(p) AS a, b FROM l WHERE NOT (i = n AND p = '')),
            q AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\s+|\\S+')) AS p, generate_subscripts(regexp_extract_all(text, '\\s+|\\S+'), 1) AS i FROM marked),
            words AS (SELECT doc_id, b - length(p) AS a, b FROM (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM q) WHERE regexp_matches(p, '^\\S'))
            SELECT e.doc_id, CAST(e.s AS INTEGER) AS start, CAST(e.e AS INTEGER) AS "end", CAST((SELECT min(line) FROM lines WHERE lines.doc_id = e.doc_id AND a <= e.s AND e.s < b) AS INTEGER) AS line,
                EXISTS (SELECT 1 FROM words WHERE words.doc_id = e.doc_id AND CASE WHEN e.s = e.e THEN a < e.s AND e.s < b ELSE a < e.e AND e.s < b END) AS in_word,
                CAST(CASE WHEN e.s = e.e AND e.e >= length(text) THEN e.s - 1 ELSE e.s END AS INTEGER) AS region_start, CAST(CASE WHEN e.s = e.e AND e.e < length(text) THEN e.e + 1 ELSE e.e END AS INTEGER) AS region_end FROM e""",
        "lease_ledger": """WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(round(abs(value)) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
            f AS (SELECT event_id, user_id, k, CAST(0 AS BIGINT) AS spent, CASE WHEN c <= 300 THEN c END AS a, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS b, CASE WHEN c <= 300 THEN 'ok' ELSE 'refused' END AS outcome FROM e WHERE k = 0
            UNION ALL SELECT e.event_id, e.user_id, e.k,
                CASE WHEN e.k % 5 = 3 AND f.a IS NOT NULL THEN f.spent + f.used ELSE f.spent END,
                CASE e.k % 5 WHEN 0 THEN CASE WHEN e.c <= 300 - f.spent THEN e.c END WHEN 3 THEN NULL ELSE f.a END,
                CASE e.k % 5 WHEN 0 THEN 0 WHEN 2 THEN CASE WHEN f.a IS NOT NULL AND e.c <= f.a THEN e.c ELSE f.used END ELSE f.used END,
                CASE e.k % 5 WHEN 1 THEN CASE WHEN e.c <= 300 - f.spent - coalesce(f.a, 0) THEN e.c END WHEN 4 THEN NULL ELSE f.b END,
                CASE e.k % 5 WHEN 0 THEN CASE WHEN e.c <= 300 - f.spent THEN 'ok' ELSE 'refused' END WHEN 1 THEN CASE WHEN e.c <= 300 - f.spent - coalesce(f.a, 0) THEN 'ok' ELSE 'refused' END
                    WHEN 2 THEN CASE WHEN f.a IS NULL THEN 'unknown' WHEN e.c > f.a THEN 'overrun' ELSE 'ok' END WHEN 3 THEN CASE WHEN f.a IS NULL THEN 'unknown' ELSE 'ok' END ELSE CASE WHEN f.b IS NULL THEN 'unknown' ELSE 'ok' END END
                FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
            SELECT event_id, outcome, spent, coalesce(a, 0) + coalesce(b, 0) AS reserved, 300 - spent - coalesce(a, 0) - coalesce(b, 0) AS remaining FROM f""",
        "findings_by_policy": " UNION ALL ".join(f"SELECT * FROM (WITH {q._findings_sql(policy=p)} SELECT '{p}' AS policy, kind, severity, removable, replacement, count(*) AS n FROM findings GROUP BY ALL)" for p in ("safe", "typographic", "aggressive")),
        "sanitize_all_policies": "SELECT 'report' AS policy, count(*) AS n_docs, CAST(0 AS BIGINT) AS n_ops FROM documents" + "".join(
            f" UNION ALL SELECT '{p}', (SELECT count(*) FROM documents), (SELECT count(*) FROM documents WHERE doc_id % {len(fixtures.INSERTS)} = 14) + (WITH {q._findings_sql(policy=p)} SELECT count(*) FROM findings WHERE removable)"
            for p in ("safe", "typographic", "aggressive")
        ),
        "recursive_rollback": f"""WITH b AS (SELECT doc_id, text AS t0, {risk('text')} AS r0 FROM documents),
            m1 AS (SELECT *, replace(t0, 'th', 'x') AS n1, {risk("replace(t0, 'th', 'x')")} AS q1 FROM b),
            h1 AS (SELECT *, CASE WHEN r0 > 2 AND q1 < r0 THEN n1 ELSE t0 END AS t1, CASE WHEN r0 > 2 AND q1 < r0 THEN q1 ELSE r0 END AS r1, CASE WHEN r0 > 2 AND q1 < r0 THEN 1 ELSE 0 END AS b1,
                CASE WHEN r0 > 2 AND NOT q1 < r0 THEN 1 ELSE 0 END AS i1, r0 > 2 AS a1 FROM m1),
            m2 AS (SELECT *, replace(t1, 'en', 'thth') AS n2, {risk("replace(t1, 'en', 'thth')")} AS q2, a1 AND r1 > 2 AS a2 FROM h1),
            h2 AS (SELECT *, CASE WHEN a2 AND q2 < r1 THEN n2 ELSE t1 END AS t2, CASE WHEN a2 AND q2 < r1 THEN q2 ELSE r1 END AS r2, CASE WHEN a2 AND q2 < r1 THEN 2 ELSE b1 END AS b2,
                CASE WHEN NOT a2 THEN i1 WHEN q2 < r1 THEN 0 ELSE i1 + 1 END AS i2 FROM m2),
            m3 AS (SELECT *, {risk("replace(t2, 'la', 'y')")} AS q3, a2 AND r2 > 2 AND i2 < 2 AS a3 FROM h2),
            h3 AS (SELECT *, CASE WHEN a3 AND q3 < r2 THEN q3 ELSE r2 END AS r3, CASE WHEN a3 AND q3 < r2 THEN 3 ELSE b2 END AS b3, CASE WHEN NOT a3 THEN i2 WHEN q3 < r2 THEN 0 ELSE i2 + 1 END AS i3 FROM m3)
            SELECT doc_id, CAST(b3 AS INTEGER) AS hop, r3 AS risk, r0 AS baseline, CAST(CASE WHEN a3 THEN 3 WHEN a2 THEN 2 WHEN a1 THEN 1 ELSE 0 END AS INTEGER) AS hops_run, r3 <= 2 AS met,
                CASE WHEN NOT a1 THEN 'source already met the requested target' WHEN r3 <= 2 THEN 'requested target met; stopping early' WHEN i3 >= 2 THEN 'stagnation limit reached; stopping early' ELSE 'hop schedule exhausted' END AS reason FROM h3""",
        "minimal_edits": f"{clean} SELECT doc_id, sha256(nfc_normalize(clean)) AS sha256, nfc_normalize(clean) <> text AS changed FROM done",
        "structured_proposals": """WITH c AS (SELECT doc_id, substr(text, 1, 20) AS phrase, unnest(range(4)) AS place FROM documents),
            k AS (SELECT *, CASE WHEN place = 3 THEN doc_id % 8 ELSE (doc_id + place) % 8 END AS kind FROM c)
            SELECT doc_id, CAST(place AS INTEGER) AS place, CASE kind WHEN 0 THEN CASE WHEN place = 0 THEN 'repeated' END WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not an object' WHEN 3 THEN 'not the two fields' WHEN 4 THEN 'empty replacement'
                WHEN 5 THEN CASE WHEN phrase = '' THEN 'empty replacement' ELSE 'no change' END WHEN 6 THEN 'operator not allowed' ELSE 'not the two fields' END AS refusal,
                CAST(CASE WHEN kind = 0 AND place > 0 THEN 1 END AS INTEGER) AS rank,
                CASE kind WHEN 0 THEN sha256('x' || phrase) WHEN 4 THEN sha256('') WHEN 5 THEN sha256(phrase) WHEN 6 THEN sha256('x') END AS sha256 FROM k""",
        "voice_by_source": _style("source"),
        "ttr_by_lang": f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '{voice.WORD.replace("'", "''")}')) AS w FROM documents)
            SELECT lang, count(*) AS n_words, count(DISTINCT lower(w)) AS n_types, count(DISTINCT lower(w)) / count(*) AS ttr FROM w GROUP BY lang""",
        "turn_bigram_divergence": f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
            g AS (SELECT conv_id, turn, {_ngrams('before', 2)} AS a, {_ngrams('text', 2)} AS b FROM c WHERE before IS NOT NULL)
            SELECT conv_id, turn, CASE WHEN len(list_distinct(a || b)) = 0 THEN 0.0::DOUBLE ELSE 1 - len(list_intersect(a, b)) / CAST(len(list_distinct(a || b)) AS DOUBLE) END AS divergence FROM g""",
        "benchmark_8gram_overlap": f"""WITH a AS (SELECT doc_id, unnest({_ngrams('text', 8)}) AS g FROM documents), b AS (SELECT item_id, unnest({_ngrams('text', 8)}) AS g FROM benchmark)
            SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (g) GROUP BY doc_id, item_id""",
        "html_meta_evidence": f"WITH {evidence} SELECT page_id, kind, place, value FROM evidence",
        "html_clean": f"""WITH {evidence}, v AS (SELECT t.page_id, t.html, e.value FROM tagged t LEFT JOIN evidence e USING (page_id))
            SELECT page_id, sha256(CASE WHEN value IS NULL THEN html ELSE replace(html, value, '') END) AS sha256 FROM v""",
        "evidence_state": f"WITH {evidence} SELECT p.page_id, coalesce(e.kind, 'not_detected') AS state FROM pages p LEFT JOIN evidence e USING (page_id)",
        "frontmatter_lines": f"""WITH f AS ({q._FRONTED}), l AS (SELECT unnest(front) AS line FROM f), k AS (SELECT replace(replace(lower(split_part(line, ':', 1)), '-', '_'), ' ', '_') AS key, line FROM l)
            SELECT key, CASE WHEN contains(line, 'Claude') THEN 'unsigned_ai_metadata' ELSE 'embedded_metadata' END AS kind, count(*) AS n FROM k WHERE key IN ('author', 'creation_date', 'tool') GROUP BY ALL""",
        "frontmatter_clean": f"""WITH f AS ({q._FRONTED}) SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'topic: x' || chr(10) || '---' || chr(10) || body WHEN 1 THEN body
            ELSE '---' || chr(10) || 'topic: y' || chr(10) || '---' || chr(10) || body END) AS sha256 FROM f""",
        "budget_admission": """WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(round(abs(value)) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
            f AS (SELECT event_id, user_id, k, c <= 200 AS admitted, CASE WHEN c <= 200 THEN c ELSE 0 END AS spent FROM e WHERE k = 1
            UNION ALL SELECT e.event_id, e.user_id, e.k, f.spent + e.c <= 200, CASE WHEN f.spent + e.c <= 200 THEN f.spent + e.c ELSE f.spent END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
            SELECT event_id, CAST(spent AS BIGINT) AS spent, admitted FROM f""",
        "event_sequence": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events",
        "event_rates": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
        "rejection_tally": f"WITH c AS ({candidates}) SELECT CASE WHEN NOT valid THEN 'fidelity' WHEN NOT target_met THEN 'target' ELSE 'none' END AS reason, count(*) AS n, min(risk) AS best_risk FROM c GROUP BY ALL",
        "candidate_ids": f"WITH c AS ({candidates}) SELECT doc_id, CAST(idx AS INTEGER) AS idx, substr(sha256(candidate_id || '|' || content_hash), 1, 12) AS id FROM c",
        "ops_validate": """WITH e AS (SELECT doc_id, text, length(text) AS n, unnest(range(4)) AS i FROM documents),
            o AS (SELECT doc_id, text, n, CASE WHEN i = 3 THEN n + 1 ELSE i * 5 END AS s, CASE WHEN i = 1 THEN 12 WHEN i = 3 THEN n + 2 ELSE i * 5 + 2 END AS e FROM e),
            l AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e) AS b FROM o),
            r AS (SELECT doc_id, s, e, CASE WHEN e > n THEN 'out_of_bounds' WHEN b > s THEN 'overlap' END AS reason FROM l)
            SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", reason FROM r WHERE reason IS NOT NULL""",
        "stagnation": f"""WITH c AS ({candidates}), b AS (SELECT doc_id, CAST(idx AS INTEGER) AS round, risk, min(risk) OVER (PARTITION BY doc_id ORDER BY idx) AS best FROM c),
            f AS (SELECT *, min(round) OVER (PARTITION BY doc_id, best) AS since FROM b) SELECT doc_id, round, risk, best, CAST(round - since AS INTEGER) AS stagnant FROM f""",
        "detection_metrics": """WITH j AS (SELECT d.lang, l.toxic = 1 AS truth, contains(d.text, 'idiot') AS predicted FROM labels l JOIN documents d USING (doc_id))
            SELECT lang, count(*) AS n, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (truth AND predicted) / nullif(count(*) FILTER (truth), 0) AS detection_rate,
            count(*) FILTER (NOT truth AND predicted) / nullif(count(*) FILTER (NOT truth), 0) AS false_positive_rate FROM j GROUP BY lang""",
        "before_after_flip": """WITH z AS (SELECT CAST((doc_id * 7) % 16 AS DOUBLE) / 4 AS z1, CAST((doc_id * 5) % 16 AS DOUBLE) / 4 AS z2 FROM documents)
            SELECT count(*) AS n, count(*) FILTER (z1 > 2 AND NOT z2 > 2) / nullif(count(*) FILTER (z1 > 2), 0) AS flip_rate, avg(z1 - z2) AS mean_z_reduction FROM z""",
        "provider_separation": f"""WITH r AS (SELECT c_custkey, {names}[c_custkey % 5 + 1] AS s, {names}[c_custkey % 3 + 1] AS w FROM customer)
            SELECT c_custkey, {family('s')} AS source, {family('w')} AS rewrite FROM r WHERE {family('s')} <> {family('w')}""",
        "config_precedence": f"""WITH r AS (SELECT 'k' || (o_orderkey % 50) AS key, {layers}[o_orderkey % 7 % 6 + 1] AS layer, count(*) AS value FROM orders GROUP BY ALL)
            SELECT key, value, layer FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY list_position({layers}, layer)) = 1""",
        "target_states": f"""WITH c AS ({candidates}), m AS (SELECT ['verify_below_threshold', 'relative_reduction', 'minimize_surrogate', 'stress_test'][doc_id % 4 + 1] AS mode, CASE WHEN idx % 2 = 0 THEN 'surrogate' ELSE 'named' END AS kind, risk FROM c)
            SELECT mode, kind, CASE mode WHEN 'verify_below_threshold' THEN kind <> 'surrogate' AND risk <= 0.5 WHEN 'relative_reduction' THEN 0.75 - risk > 0 AND 0.75 - risk >= 0.125
            WHEN 'minimize_surrogate' THEN kind = 'surrogate' AND 0.75 - risk > 0.125 ELSE false END AS met, count(*) AS n FROM m GROUP BY ALL""",
        "one_shot_select": f"""WITH {options}, c AS (SELECT doc_id, result, least(1.0::DOUBLE, greatest(length(a), length(b)) / CAST(length(text) AS DOUBLE)) AS cr, abs(length(result) - length(text)) / CAST(length(text) AS DOUBLE) AS dr, {risk('result')} AS risk FROM made)
            SELECT doc_id, sha256(result) AS sha256, risk, risk <= 50 AS target_met FROM c WHERE cr <= 0.2 AND dr <= 0.1
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN risk <= 50 THEN 0 ELSE 1 END, round(cr, 6), round(dr, 6), risk, sha256(result)) = 1""",
    }

