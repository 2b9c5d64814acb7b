"""SQL that DuckDB runs over the same tables, one statement per query of the core, written apart from the operators: windows over
exploded rows where those use arrays."""

from __future__ import annotations

from plyforge.functions.fen import ERRORS
from plyforge.operators import vocab as V
from plyforge.plans.queries import BATCH, BLOCK, DROPOUT, FEN_SQL, FILTERS, MIN_P, MONTHS, PREFIXES, SEED, TEMPERATURE, TOP_P, U, VAL_SHARE

SQL: dict[str, str] = {}

# Problem 3

#: The names in this project's data, written down apart from the operator's.
_NAMES = {
    "result": ("result", "Result", "gameResult", "game_result", "outcome", "res", "final_score", "score"),
    "termination": ("termination", "Termination", "terminationType", "how_ended", "ended_by", "end_reason", "finish", "term"),
}
_FIELD = "CASE " + " ".join(f"WHEN key IN ({', '.join(map(repr, names))}) THEN '{field}'" for field, names in _NAMES.items()) + " END"
_KIND = """CASE json_type(payload, '$."' || key || '"') WHEN 'VARCHAR' THEN 'text' WHEN 'UBIGINT' THEN 'whole' WHEN 'BIGINT' THEN 'whole'
    WHEN 'HUGEINT' THEN 'whole' WHEN 'DOUBLE' THEN 'decimal' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' WHEN 'BOOLEAN' THEN 'bool' ELSE 'null' END"""
_PAIRS = f"""SELECT feed, shard_no, key, {_KIND} AS kind FROM (
    SELECT feed, shard_no, payload, unnest(json_keys(payload)) AS key FROM shard_rows
    WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END)"""

SQL["p3_profile"] = f"SELECT feed, shard_no, key, kind, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL"
SQL["p3_found"] = f"""
    WITH pairs AS ({_PAIRS}),
    state AS (SELECT feed, shard_no, {_FIELD} AS field_name, min(key) AS key, mode(CASE WHEN kind <> 'null' THEN kind END) AS kind FROM pairs WHERE {_FIELD} IS NOT NULL GROUP BY ALL),
    now AS (SELECT * FROM (SELECT DISTINCT feed, shard_no FROM shard_rows) CROSS JOIN (VALUES ('result'), ('termination')) AS f(field_name) LEFT JOIN state USING (feed, shard_no, field_name)),
    both_ AS (SELECT n.feed, n.shard_no, n.field_name, n.key, n.kind, b.key AS key_before, b.kind AS kind_before FROM now n JOIN now b ON n.feed = b.feed AND n.field_name = b.field_name AND n.shard_no = b.shard_no + 1)
    SELECT feed, shard_no, field_name, 'added' AS change_kind FROM both_ WHERE key_before IS NULL AND key IS NOT NULL
    UNION ALL SELECT feed, shard_no, field_name, 'removed' FROM both_ WHERE key_before IS NOT NULL AND key IS NULL
    UNION ALL SELECT feed, shard_no, field_name, 'renamed' FROM both_ WHERE key_before <> key
    UNION ALL SELECT feed, shard_no, field_name, 'retyped' FROM both_ WHERE key_before IS NOT NULL AND key IS NOT NULL AND kind_before <> kind"""

SQL["p3_alternatives"] = f"""
    WITH kinds AS (SELECT feed, shard_no, {_FIELD} AS field_name, key AS path, kind AS type, count(*) AS n FROM ({_PAIRS}) WHERE {_FIELD} IS NOT NULL AND kind <> 'null' GROUP BY ALL)
    SELECT feed, shard_no, field_name, path, type, n, EXISTS (SELECT 1 FROM kinds o WHERE o.feed = k.feed AND o.shard_no = k.shard_no AND o.field_name = k.field_name AND (o.path <> k.path OR o.type <> k.type)) AS beside_another
    FROM kinds k WHERE EXISTS (SELECT 1 FROM shard_rows p WHERE p.feed = k.feed AND p.shard_no = k.shard_no - 1)
    AND NOT EXISTS (SELECT 1 FROM kinds b WHERE b.feed = k.feed AND b.shard_no = k.shard_no - 1 AND b.field_name = k.field_name AND b.path = k.path AND b.type = k.type)"""
SQL["p3_readable"] = """SELECT feed, shard_no, count(*) AS n_rows, count(*) FILTER (CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END) AS n_readable,
    count(CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.site') AS VARCHAR) END) AS n_sites FROM shard_rows GROUP BY ALL"""

# Stage 1

_EVAL = r"\[%eval\s+(#?-?\d+(?:\.\d+)?)\]"
_SAN = r"(?:O-O-O|O-O|[KQRBN][a-h]?[1-8]?x?[a-h][1-8]|[a-h]x[a-h][1-8]|[a-h][1-8])(?:=[QRBN])?[+#]?"
_LOOSE = r"(?:[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?|O-O(?:-O)?)[+#]?"
_LEX = r"""SELECT raw_id, whiteelo, blackelo, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS i FROM (
    SELECT raw_id, whiteelo, blackelo, regexp_extract_all(movetext, '\{[^}]*\}|\d+\.(?:\.\.)?|\$\d+|[^\s{}]+') AS l FROM raw_games WHERE movetext IS NOT NULL)"""


def _glyph(word: str) -> str:
    return f"CASE WHEN suffix({word}, '??') THEN '??' WHEN suffix({word}, '?!') THEN '?!' WHEN suffix({word}, '?') THEN '?' WHEN suffix({word}, '!!') THEN '!!' WHEN suffix({word}, '!?') THEN '!?' WHEN suffix({word}, '!') THEN '!' END"


def _cp(ev: str) -> str:
    n = f"TRY_CAST(substr({ev}, 2) AS INT)"
    return f"CASE WHEN starts_with({ev}, '#') THEN CASE WHEN {n} >= 0 THEN 30000 - {n} ELSE -30000 - {n} END ELSE CAST(round_even(CAST({ev} AS DOUBLE) * 100, 0) AS INT) END"


def _win(cp: str) -> str:
    return f"(50 + 50 * (2 / (1 + exp(-0.00368208 * greatest(-10000, least(10000, {cp})))) - 1))"


_PLIES = rf"""
    lex AS ({_LEX}),
    kinds AS (SELECT *, CASE WHEN starts_with(t, '{{') THEN 'c' WHEN regexp_full_match(t, '\d+\.(\.\.)?') THEN 'n' WHEN regexp_full_match(t, '\$\d+') THEN 'g' WHEN t IN ('1-0', '0-1', '1/2-1/2', '*') THEN 'r' ELSE 'p' END AS kind FROM lex),
    numbered AS (SELECT *, sum(CASE WHEN kind = 'p' THEN 1 ELSE 0 END) OVER (PARTITION BY raw_id ORDER BY i) - 1 AS ply, CASE WHEN kind = 'c' THEN nullif(regexp_extract(t, '{_EVAL}', 1), '') END AS ev FROM kinds),
    words AS (SELECT raw_id, ply, any_value(whiteelo) AS whiteelo, any_value(blackelo) AS blackelo, max(CASE WHEN kind = 'p' THEN t END) AS word, arg_max(ev, CASE WHEN ev IS NOT NULL THEN i END) AS ev FROM numbered WHERE ply >= 0 GROUP BY raw_id, ply),
    plies AS (SELECT raw_id, whiteelo, blackelo, CAST(ply AS INT) AS ply, {_glyph('word')} AS glyph, left(word, length(word) - coalesce(length({_glyph('word')}), 0)) AS san, ev, {_cp('ev')} AS cp FROM words),
    carried AS (SELECT *, ply % 2 = 0 AS white, coalesce(last_value(cp IGNORE NULLS) OVER (PARTITION BY raw_id ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 15) AS cp_before FROM plies),
    loss AS (SELECT *, ({_win('cp_before')} - {_win('cp')}) * CASE WHEN white THEN 1 ELSE -1 END AS loss, CASE WHEN glyph IN ('??', '?!', '?') THEN glyph END AS inline FROM carried),
    labelled AS (SELECT *, CASE WHEN cp IS NULL THEN NULL WHEN loss >= 30 THEN '??' WHEN loss >= 20 THEN '?' WHEN loss >= 10 THEN '?!' END AS computed FROM loss),
    marked AS (SELECT *, cp IS NOT NULL AND inline IS DISTINCT FROM computed AS disagrees FROM labelled)"""


def _bucket(elo: str, missing: str = "<elo-u800>") -> str:
    return f"CASE WHEN {elo} IS NULL THEN '{missing}' WHEN {elo} < 800 THEN '<elo-u800>' WHEN {elo} >= 3000 THEN '<elo-3000p>' ELSE '<elo-' || CAST(CAST(floor({elo} / 200) AS INT) * 200 AS VARCHAR) || '>' END"


def _tokens(label: str) -> str:
    base = "regexp_replace(san, '(=[QRBN])?[+#]?$', '')"
    parts = [label, "nullif(regexp_extract(san, '([+#])$', 1), '')", f"CASE WHEN contains({base}, 'x') THEN 'x' END", "nullif(regexp_extract(san, '(=[QRBN])[+#]?$', 1), '')", f"replace({base}, 'x', '')"]
    return "concat_ws(' ', " + ", ".join(f"'[' || {p} || ']'" for p in parts) + ")"


_GAMES = f"""
    games1 AS (SELECT raw_id, count(*) AS n_plies, bool_or(ev IS NOT NULL) AS has_evals, bool_or(NOT regexp_full_match(san, '{_SAN}') OR (ev IS NOT NULL AND cp IS NULL)) AS malformed,
        string_agg({_tokens('inline')}, ' ' ORDER BY ply) AS tokens, string_agg({_tokens('computed')}, ' ' ORDER BY ply) AS tokens_computed,
        string_agg(CAST(coalesce(cp, 30001) AS VARCHAR), ' ' ORDER BY ply) AS cp, count(*) FILTER (disagrees) AS n_disagreements FROM marked GROUP BY raw_id),
    scanned AS (SELECT * FROM raw_games WHERE contains(movetext, '[%eval') AND whiteelo IS NOT NULL AND blackelo IS NOT NULL)"""

SQL["nerf_rate_by_elo"] = f"""WITH {_PLIES} SELECT {_bucket('mover')} AS bucket, count(*) AS n_plies, count(computed) AS n_errors, count(*) FILTER (computed = '??') AS n_blunders, round(count(computed) / count(*), 6) AS rate
    FROM (SELECT CASE WHEN white THEN whiteelo ELSE blackelo END AS mover, computed FROM labelled JOIN raw_games r USING (raw_id) WHERE contains(r.movetext, '[%eval') AND r.whiteelo >= 0 AND r.blackelo >= 0) GROUP BY 1"""
SQL["nerf_rate_by_elo"] = SQL["nerf_rate_by_elo"].replace("CASE WHEN white THEN whiteelo ELSE blackelo END", "CASE WHEN white THEN labelled.whiteelo ELSE labelled.blackelo END")
SQL["scan_filter_pushdown"] = "SELECT raw_id, site, whiteelo, blackelo FROM raw_games WHERE contains(movetext, '[%eval') AND whiteelo >= 1600 AND blackelo >= 1600"
SQL["zst_json_roundtrip"] = "SELECT raw_id, site, md5(movetext) AS text_md5 FROM raw_games"
SQL["p3_checks"] = """SELECT count(*) AS n_rows, count(*) FILTER (CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END) AS n_readable, 0 AS n_other_results, 0 AS n_other_terminations, 0 AS n_different FROM shard_rows"""
_SECONDS = r"(TRY_CAST(regexp_extract(timecontrol, '^(\d+)\+(\d+)$', 1) AS INT) + 40 * TRY_CAST(regexp_extract(timecontrol, '^(\d+)\+(\d+)$', 2) AS INT))"
SQL["strict_games"] = f"""WITH {_PLIES}, n AS (SELECT raw_id, count(*) AS n_plies, max(ply) AS last, count(ev) FILTER (ply < top) AS before_last FROM (SELECT *, max(ply) OVER (PARTITION BY raw_id) AS top FROM plies) GROUP BY raw_id)
    SELECT raw_id, n_plies, CASE WHEN {_SECONDS} < 480 THEN 'blitz' WHEN {_SECONDS} < 1500 THEN 'rapid' ELSE 'classical' END AS speed FROM raw_games JOIN n USING (raw_id)
    WHERE contains(movetext, '[%eval') AND whiteelo IS NOT NULL AND blackelo IS NOT NULL AND coalesce(termination, '') NOT IN ('Abandoned', 'Rules infraction') AND {_SECONDS} >= 180 AND n_plies >= 10 AND before_last = n_plies - 1"""
SQL["lex_tokens"] = f"SELECT raw_id, i, t AS lexeme FROM ({_LEX})"
SQL["movetext_result"] = f"SELECT r.raw_id, x.text_result FROM raw_games r LEFT JOIN (SELECT raw_id, arg_max(t, i) AS text_result FROM ({_LEX}) WHERE t IN ('1-0', '0-1', '1/2-1/2', '*') GROUP BY raw_id) x USING (raw_id)"
SQL["parse_plies"] = f"WITH {_PLIES} SELECT raw_id, ply, san, glyph, cp FROM plies"
SQL["eval_to_cp"] = f"SELECT ev AS eval, {_cp('ev')} AS cp FROM (SELECT DISTINCT unnest(regexp_extract_all(movetext, '{_EVAL}', 1)) AS ev FROM raw_games)"
SQL["win_pct"] = f"SELECT cp, round({_win('cp')}, 6) AS pct FROM (SELECT DISTINCT unnest(cp) AS cp FROM games)"
SQL["carry_forward_eval"] = f"WITH {_PLIES} SELECT raw_id, ply, cp, cp_before FROM carried"
SQL["label_plies"] = f"WITH {_PLIES} SELECT raw_id, ply, inline, computed, disagrees FROM marked"
SQL["label_histogram"] = f"WITH {_PLIES} SELECT coalesce(computed, 'none') AS label, count(*) AS n FROM labelled GROUP BY 1"
SQL["glyph_disagreements"] = f"WITH {_PLIES} SELECT coalesce(inline, 'none') AS inline, coalesce(computed, 'none') AS computed, count(*) AS n FROM marked WHERE disagrees GROUP BY 1, 2"
SQL["split_glyph"] = f"SELECT word, left(word, length(word) - coalesce(length({_glyph('word')}), 0)) AS san, {_glyph('word')} AS glyph FROM (SELECT DISTINCT t AS word FROM ({_LEX}) WHERE NOT starts_with(t, '{{'))"
SQL["san_tokens"] = f"WITH {_PLIES} SELECT san, CASE WHEN regexp_full_match(san, '{_SAN}') THEN {_tokens('CAST(NULL AS VARCHAR)')} END AS tokens, regexp_full_match(san, '{_LOOSE}') AS loose FROM (SELECT DISTINCT san FROM plies)"
SQL["tokens_to_san"] = f"WITH {_PLIES} SELECT DISTINCT san, san AS back FROM plies WHERE regexp_full_match(san, '{_SAN}')"
SQL["tokenise_games"] = f"""WITH {_PLIES}, {_GAMES} SELECT raw_id, coalesce(site, '') AS site, coalesce(CAST(utcdate AS VARCHAR), '') AS utc_date, whiteelo AS white_elo, blackelo AS black_elo, timecontrol AS time_control, result, termination, eco,
    n_plies, tokens, cp, n_disagreements FROM games1 JOIN scanned USING (raw_id) WHERE has_evals AND NOT malformed AND n_plies >= 20 AND whiteelo >= 1600 AND blackelo >= 1600"""
SQL["stream_stage1"] = SQL["tokenise_games_native"] = SQL["tokenise_games"]
SQL["label_plies_native"] = SQL["label_plies"]
SQL["tokenise_games_computed"] = f"WITH {_PLIES}, {_GAMES} SELECT raw_id, tokens_computed AS tokens FROM games1 JOIN scanned USING (raw_id) WHERE has_evals AND NOT malformed AND whiteelo >= 0 AND blackelo >= 0"
SQL["quarantine_games"] = f"WITH {_PLIES}, {_GAMES} SELECT raw_id FROM games1 JOIN scanned USING (raw_id) WHERE has_evals AND malformed AND whiteelo >= 0 AND blackelo >= 0"
SQL["stage1_stats"] = f"""WITH {_PLIES}, {_GAMES}, kept AS (SELECT * FROM games1 JOIN scanned USING (raw_id) WHERE has_evals AND whiteelo >= 1600 AND blackelo >= 1600 AND (malformed OR n_plies >= 20)),
    good AS (SELECT * FROM kept WHERE NOT malformed), tok AS (SELECT unnest(string_split(tokens, ' ')) AS t FROM good)
    SELECT (SELECT count(*) FROM good) AS games, (SELECT CAST(coalesce(sum(n_plies), 0) AS BIGINT) FROM good) AS plies, (SELECT count(*) FROM tok) AS tokens, (SELECT count(DISTINCT t) FROM tok) AS distinct_tokens,
    (SELECT count(*) FROM kept WHERE malformed) AS parse_errors, (SELECT CAST(coalesce(sum(n_disagreements), 0) AS BIGINT) FROM good) AS disagreement_plies"""
SQL["games_per_month_limit"] = "SELECT * FROM (SELECT raw_id, month, row_number() OVER (PARTITION BY month ORDER BY raw_id) AS rank FROM (SELECT raw_id, replace(substr(coalesce(utcdate, ''), 1, 7), '.', '-') AS month FROM raw_games)) WHERE rank <= 5"

# Token streams, dictionary, Stage 2

_STREAM = r"CASE WHEN contains(tokens, '[') THEN regexp_extract_all(tokens, '\[([^\]]*)\]', 1) ELSE list_filter(regexp_split_to_array(tokens, '\s+'), lambda t: t <> '') END"
_VOCAB = f"vocab AS (SELECT unnest([{', '.join(repr(t) for t in V.tokens())}]) AS word, unnest(range({len(V.tokens())})) AS token_id)"
_KINDS = "CASE WHEN token_id < 5242 THEN 'core' WHEN token_id < 5249 THEN 'modifier' WHEN token_id < 5252 THEN 'label' WHEN token_id < 5254 THEN 'frame' WHEN token_id < 5268 THEN 'elo' ELSE 'end' END"


def _word(t: str) -> str:
    bare = f"regexp_replace({t}, '^\\[(.*)\\]$', '\\1')"
    return f"CASE {bare} WHEN '??' THEN '<blunder>' WHEN '?' THEN '<mistake>' WHEN '?!' THEN '<inaccuracy>' ELSE {bare} END"


def _in(names: tuple[str, ...]) -> str:
    return ", ".join(map(repr, names))


def _fraction(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT % 10000) / 10000)"


_TOK = f"tok AS (SELECT row_id, unnest(s) AS token, generate_subscripts(s, 1) AS i FROM (SELECT row_id, {_STREAM} AS s FROM games WHERE tokens IS NOT NULL))"
_END = "CASE WHEN result = '1/2-1/2' AND termination = 'Normal' THEN '<draw>' WHEN result IN ('1-0', '0-1') AND termination = 'Normal' AND NOT coalesce(mate, false) THEN CASE result WHEN '1-0' THEN '<black-resign>' ELSE '<white-resign>' END WHEN result IN ('1-0', '0-1') AND termination = 'Time forfeit' THEN CASE result WHEN '1-0' THEN '<black-flag>' ELSE '<white-flag>' END END"
_ENC = f"""{_VOCAB}, {_TOK},
    looked AS (SELECT t.row_id, t.i, t.token, {_word('t.token')} AS word FROM tok t),
    ids AS (SELECT l.*, v.token_id FROM looked l LEFT JOIN vocab v USING (word)),
    per AS (SELECT row_id, list(token_id ORDER BY i) AS move_ids, bool_or(token_id IS NULL) AS bad, bool_or(word = '#') AS mate FROM ids GROUP BY row_id),
    framed AS (SELECT g.row_id, g.site, g.utc_date, g.white_elo, g.black_elo, g.n_plies, coalesce(bad, false) AS bad, coalesce(move_ids, []) AS move_ids, {_END} AS end_token, {_bucket('coalesce(white_elo, 0)')} AS white_token, {_bucket('coalesce(black_elo, 0)')} AS black_token,
        CASE WHEN {_fraction("coalesce(site, '')")} < {VAL_SHARE} THEN 'val' ELSE 'train' END AS split FROM games g LEFT JOIN per USING (row_id)),
    encoded AS (SELECT f.*, list_concat([5252, w.token_id, b.token_id], move_ids, CASE WHEN e.token_id IS NULL THEN [5253] ELSE [e.token_id, 5253] END) AS ids FROM framed f JOIN vocab w ON w.word = white_token JOIN vocab b ON b.word = black_token LEFT JOIN vocab e ON e.word = end_token WHERE NOT bad),
    corpus AS (SELECT row_id, split, len(ids) AS length, ids, CAST(coalesce(sum(len(ids)) OVER (PARTITION BY split ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM encoded)"""

SQL["token_frequency"] = f"WITH {_TOK} SELECT token, count(*) AS n FROM tok GROUP BY 1"
SQL["token_frequency_top"] = f"WITH {_TOK} SELECT token, count(*) AS n FROM tok GROUP BY 1 ORDER BY n DESC, token LIMIT 20"
SQL["vocab_table"] = f"WITH {_VOCAB} SELECT token_id, word AS token, {_KINDS} AS kind FROM vocab"
SQL["vocab_kind_counts"] = f"WITH {_VOCAB} SELECT {_KINDS} AS kind, count(*) AS n, count(DISTINCT word) AS n_distinct, min(token_id) AS first_id, max(token_id) AS last_id FROM vocab GROUP BY 1"
SQL["translate_tokens"] = f"WITH {_TOK} SELECT DISTINCT token, {_word('token')} AS word FROM tok"
SQL["encode_lookup"] = f"WITH {_VOCAB}, {_TOK} SELECT token, token_id FROM (SELECT DISTINCT token, {_word('token')} AS word FROM tok) LEFT JOIN vocab USING (word)"
SQL["elo_bucket"] = f"SELECT elo, {_bucket('elo')} AS training, {_bucket('elo', '<elo-any>')} AS serving FROM (SELECT white_elo AS elo FROM games UNION SELECT black_elo FROM games)"
SQL["end_token_class"] = f"WITH {_ENC} SELECT coalesce(end_token, 'bare') AS end_token, count(*) AS n FROM framed GROUP BY 1"
SQL["encode_games"] = f"WITH {_ENC} SELECT row_id, split, length, array_to_string(ids, ' ') AS ids FROM corpus"
SQL["decode_games"] = f"WITH {_ENC} SELECT row_id, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT row_id, unnest(ids) AS token_id, generate_subscripts(ids, 1) AS i FROM corpus) JOIN vocab USING (token_id) GROUP BY row_id"
SQL["elo_dropout_hash"] = "SELECT row_id, " + ", ".join(
    f"CASE WHEN {_fraction(f"'{SEED}|{s[0]}|' || row_id")} < {DROPOUT} THEN '<elo-any>' ELSE {_bucket(f'coalesce({s}_elo, 0)')} END AS {s}_token" for s in ("white", "black")
) + " FROM games"
SQL["hash_split"] = f"SELECT row_id, CASE WHEN {_fraction("coalesce(site, '')")} < {VAL_SHARE} THEN 'val' ELSE 'train' END AS split FROM games"
SQL["month_split"] = f"SELECT row_id, CASE WHEN replace(substr(coalesce(utc_date, ''), 1, 7), '.', '-') IN ({_in(MONTHS)}) THEN 'val' ELSE 'train' END AS split FROM games"
_FILTER = f"least(coalesce(white_elo, 0), coalesce(black_elo, 0)) >= {FILTERS['min_elo']} AND greatest(coalesce(white_elo, 0), coalesce(black_elo, 0)) <= {FILTERS['max_elo']} AND coalesce(n_plies, 0) >= {FILTERS['min_plies']}"
SQL["stage2_filters"] = f"SELECT row_id, white_elo, black_elo, n_plies FROM games WHERE {_FILTER}"
SQL["unknown_token_docfreq"] = f"WITH {_ENC} SELECT token, count(DISTINCT row_id) AS n_games FROM ids WHERE token_id IS NULL GROUP BY 1"
SQL["unknown_token_top"] = SQL["unknown_token_docfreq"] + " ORDER BY n_games DESC, token LIMIT 20"
SQL["pack_stats"] = f"""WITH {_ENC}, kept AS (SELECT * FROM framed WHERE {_FILTER}), good AS (SELECT c.*, k.end_token FROM corpus c JOIN kept k USING (row_id))
    SELECT (SELECT count(*) FROM games) AS games_seen, (SELECT count(*) FROM games) - (SELECT count(*) FROM kept) AS games_filtered, count(*) AS games_packed, (SELECT count(*) FROM kept WHERE bad) AS games_unknown_token,
    count(*) FILTER (split = 'train') AS train_games, count(*) FILTER (split = 'val') AS val_games, CAST(coalesce(sum(length) FILTER (split = 'train'), 0) AS BIGINT) AS train_tokens, CAST(coalesce(sum(length) FILTER (split = 'val'), 0) AS BIGINT) AS val_tokens,
    round_even(sum(length) / greatest(1, count(*)), 1) AS tokens_per_game, count(*) FILTER (end_token LIKE '%resign>') AS games_end_resign, count(*) FILTER (end_token LIKE '%flag>') AS games_end_flag, count(*) FILTER (end_token = '<draw>') AS games_end_draw,
    count(*) FILTER (end_token IS NULL) AS games_end_bare, max(length) AS max_game_tokens, count(*) FILTER (length > 513) AS games_over_513, count(*) FILTER (length > 1025) AS games_over_1025 FROM good"""
SQL["split_stats"] = f"WITH {_ENC} SELECT split, count(*) AS n_games, CAST(sum(length) AS BIGINT) AS n_tokens FROM corpus GROUP BY 1"
SQL["game_offsets"] = f"WITH {_ENC} SELECT split, row_id, length, start FROM corpus"
SQL["offset_index"] = f"WITH {_ENC} SELECT split, start FROM corpus UNION ALL SELECT split, CAST(sum(length) AS BIGINT) FROM corpus GROUP BY 1"
SQL["offset_scan"] = SQL["offset_index"]
SQL["offsets_valid"] = f"WITH {_ENC} SELECT split, min(start) = 0 AND bool_and(coalesce(next = start + length, true)) AS valid FROM (SELECT *, lead(start) OVER (PARTITION BY split ORDER BY start) AS next FROM corpus) GROUP BY 1"
SQL["inspect_corpus"] = f"""WITH {_ENC}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) AS rank FROM corpus) WHERE rank <= 3)
    SELECT split, row_id, length, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT split, row_id, length, unnest(ids[1:40]) AS token_id, generate_subscripts(ids[1:40], 1) AS i FROM top) JOIN vocab USING (token_id) GROUP BY ALL"""
SQL["vocab_check"] = f"""WITH {_PLIES}, {_VOCAB}, s AS (SELECT raw_id, ply, san, regexp_full_match(san, '{_SAN}') AS ok FROM plies),
    parts AS (SELECT raw_id, ply, unnest(string_split({_tokens('CAST(NULL AS VARCHAR)')}, ' ')) AS token FROM s WHERE ok),
    miss AS (SELECT DISTINCT raw_id, ply FROM parts LEFT JOIN vocab ON word = {_word('token')} WHERE word IS NULL)
    SELECT (SELECT count(*) FROM s) AS checked, (SELECT count(*) FROM s WHERE NOT ok) AS broken, (SELECT count(*) FROM miss) AS missing, CAST(0 AS BIGINT) AS lossy"""
SQL["corpus_roundtrip"] = f"WITH {_ENC} SELECT split, array_to_string(ids, ' ') AS ids FROM corpus"

# Buckets and segments

_CAPS = [c for c in (64, 128, 256, 384, 512, 768, 1024) if c < BLOCK] + [BLOCK]
_CAP = "CASE " + " ".join(f"WHEN length - 1 <= {c} THEN {c}" for c in _CAPS) + " END"


def _rows(cap: str, block: int, batch: int) -> str:
    return f"CAST(greatest(1, least({8 * batch}, round_even({float(block * batch)} / {cap}, 0))) AS INT)"


SQL["length_histogram"] = f"WITH {_ENC} SELECT length, count(*) AS n FROM corpus GROUP BY 1"
SQL["bucket_assign"] = f"WITH {_ENC} SELECT row_id, length, {_CAP} AS cap FROM corpus"
SQL["bucket_mass"] = f"""WITH {_ENC}, b AS (SELECT split, {_CAP} AS cap, count(*) AS n_games, CAST(sum(length) AS BIGINT) AS n_tokens FROM corpus GROUP BY 1, 2)
    SELECT split, cap, CASE WHEN cap IS NULL THEN NULL ELSE {_rows('cap', BLOCK, BATCH)} END AS rows, n_games, n_tokens, round(CASE WHEN cap IS NOT NULL THEN n_tokens / sum(n_tokens) FILTER (cap IS NOT NULL) OVER (PARTITION BY split) END, 6) AS probability FROM b"""
SQL["rows_for_cap"] = f"""SELECT c AS cap, 1024 AS block, {_rows('c', 1024, 64)} AS rows FROM (SELECT unnest([64, 128, 256, 384, 512, 768, 1024]) AS c)
    UNION ALL SELECT c, 512, {_rows('c', 512, 32)} FROM (SELECT unnest([64, 128, 256, 384, 512]) AS c)"""

_SEG = f"""{_ENC},
    cells AS (SELECT row_id, unnest(ids) AS t, generate_subscripts(ids, 1) - 1 AS pos, len(ids) AS n FROM corpus),
    near AS (SELECT *, t BETWEEN 5249 AND 5251 AS label, first_value(CASE WHEN t NOT BETWEEN 5242 AND 5248 THEN pos END IGNORE NULLS) OVER f AS p, first_value(CASE WHEN t NOT BETWEEN 5242 AND 5248 THEN t END IGNORE NULLS) OVER f AS pt
        FROM cells WINDOW f AS (PARTITION BY row_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
    labels AS (SELECT row_id, n, pos, CASE WHEN pt < 5242 THEN p END AS g FROM near WHERE label),
    stop AS (SELECT c.row_id, c.length AS n, coalesce(min(l.pos) FILTER (l.g IS NULL), c.length) AS stop FROM corpus c LEFT JOIN labels l USING (row_id) GROUP BY 1, 2, c.length),
    good AS (SELECT l.row_id, l.pos, l.g, coalesce(lag(l.g) OVER (PARTITION BY l.row_id ORDER BY l.pos) + 1, 0) AS lo FROM labels l JOIN stop s USING (row_id) WHERE l.pos < s.stop),
    tails AS (SELECT s.row_id, coalesce(max(g.g) + 1, 0) AS lo, s.stop - 1 AS hi FROM stop s LEFT JOIN good g USING (row_id) GROUP BY s.row_id, s.stop),
    segs AS (SELECT row_id, lo, hi, label_at, row_number() OVER (PARTITION BY row_id ORDER BY lo) - 1 AS seg FROM (SELECT row_id, lo, g AS hi, pos AS label_at FROM good UNION ALL SELECT row_id, lo, hi, NULL FROM tails WHERE lo <= hi)),
    kept AS (SELECT s.row_id, s.seg, s.lo, s.hi, a.pos, a.t, lag(a.pos) OVER w AS before, lag(a.t) OVER w AS x FROM segs s JOIN cells a ON a.row_id = s.row_id AND (a.t NOT BETWEEN 5249 AND 5251 OR a.pos = s.label_at) WINDOW w AS (PARTITION BY s.row_id, s.seg ORDER BY a.pos)),
    target AS (SELECT row_id, seg, pos, x, CASE WHEN (pos BETWEEN lo AND hi OR t = 5253 OR t >= 5268) AND before = pos - 1 AND NOT (t = 5252 OR t BETWEEN 5254 AND 5267) THEN t ELSE -1 END AS y FROM kept WHERE before IS NOT NULL),
    trained AS (SELECT row_id, seg, string_agg(CAST(x AS VARCHAR), ' ' ORDER BY pos) AS x, string_agg(CAST(y AS VARCHAR), ' ' ORDER BY pos) AS y, count(*) AS length, count(*) FILTER (y = -1) AS ungraded FROM target GROUP BY 1, 2)"""

SQL["segment_plan"] = f"WITH {_SEG} SELECT row_id, seg, lo, hi, label_at FROM segs"
SQL["all_segment_rows"] = f"WITH {_SEG} SELECT row_id, seg, x, y FROM trained"
SQL["graded_density"] = f"WITH {_SEG} SELECT count(*) AS n_rows, CAST(sum(length) AS BIGINT) AS n_targets, CAST(sum(length - ungraded) AS BIGINT) AS n_graded FROM trained"
SQL["pad_rows"] = f"WITH {_SEG} SELECT cap, count(*) AS n_rows, count(*) * cap AS n_inputs, CAST(sum(ungraded + cap - len) AS BIGINT) AS n_ungraded FROM (SELECT length AS len, ungraded, {_CAP.replace('length - 1', 'length')} AS cap FROM trained) WHERE cap IS NOT NULL GROUP BY cap"

_WORDS = f"{_TOK}, ws AS (SELECT row_id, i, {_word('token')} AS word FROM tok), opens AS (SELECT *, word IN ({_in(V.MODIFIERS + tuple(V.LABEL_WORDS.values()))}) AS open FROM ws)"
_GROUPS = f"""{_WORDS}, g AS (SELECT *, coalesce(sum(CASE WHEN open THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS move_no FROM opens),
    moves AS (SELECT row_id, CAST(move_no AS INT) AS move_no, string_agg(word, ' ' ORDER BY i) AS words, list(word ORDER BY i) AS tokens FROM g GROUP BY 1, 2 HAVING bool_or(NOT open))"""
SQL["regroup_moves"] = f"WITH {_GROUPS} SELECT row_id, move_no, words FROM moves"

# Distributions

_BI = f"""{_VOCAB}, {_WORDS}, pairs AS (SELECT word AS decode_id, lead(word) OVER (PARTITION BY row_id ORDER BY i) AS token FROM ws),
    counts AS (SELECT decode_id, p.token, v.token_id AS idx, count(*) AS n FROM pairs p LEFT JOIN vocab v ON v.word = p.token WHERE p.token IS NOT NULL GROUP BY 1, 2, 3),
    masked AS (SELECT decode_id, token, idx, CAST(n AS DOUBLE) AS q FROM counts WHERE idx IS NOT NULL),
    dist AS (SELECT decode_id, token, idx, q / sum(q) OVER (PARTITION BY decode_id) AS p FROM masked)"""
SQL["mask_renormalise"] = f"WITH {_BI} SELECT decode_id, token, round(p, 6) AS p FROM dist"
SQL["temperature"] = f"WITH {_BI} SELECT decode_id, token, round(pow(q, 1 / {TEMPERATURE}) / sum(pow(q, 1 / {TEMPERATURE})) OVER (PARTITION BY decode_id), 6) AS p FROM masked"
SQL["temperature_schedule"] = "SELECT move, CASE WHEN move >= 30 THEN 0.4 WHEN move >= 10 THEN 0.05 ELSE 1.0 END::DOUBLE AS t FROM (SELECT DISTINCT CAST(floor(coalesce(n_plies, 0) / 2) + 1 AS INT) AS move FROM games)"
SQL["top_p"] = f"""WITH {_BI}, run AS (SELECT *, coalesce(sum(CASE WHEN token = '#' THEN 0 ELSE p END) OVER (PARTITION BY decode_id ORDER BY p DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dist)
    SELECT decode_id, token, round(p / sum(p) OVER (PARTITION BY decode_id), 6) AS p FROM run WHERE before < {TOP_P} OR token = '#'"""
SQL["min_p"] = f"WITH {_BI}, best AS (SELECT *, row_number() OVER (PARTITION BY decode_id ORDER BY p DESC, idx) AS r FROM dist) SELECT decode_id, token, round(p / sum(p) OVER (PARTITION BY decode_id), 6) AS p FROM best WHERE p >= {MIN_P} OR r = 1"
SQL["shaping_chain"] = f"""WITH {_BI}, warm AS (SELECT decode_id, idx, token, pow(q, 1 / {TEMPERATURE}) / sum(pow(q, 1 / {TEMPERATURE})) OVER (PARTITION BY decode_id) AS p FROM masked),
    run AS (SELECT *, coalesce(sum(CASE WHEN token = '#' THEN 0 ELSE p END) OVER (PARTITION BY decode_id ORDER BY p DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM warm),
    nucleus AS (SELECT decode_id, idx, token, p / sum(p) OVER (PARTITION BY decode_id) AS p FROM run WHERE (before < {TOP_P} OR token = '#') AND p > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY decode_id ORDER BY (token = '#')::INT, p DESC, idx) AS r FROM nucleus)
    SELECT decode_id, token, round(p / sum(p) OVER (PARTITION BY decode_id), 6) AS p FROM ranked WHERE p >= {MIN_P} OR token = '#' OR r = 1"""
SQL["softmax"] = f"WITH {_BI} SELECT decode_id, token, round(sqrt(n) / sum(sqrt(n)) OVER (PARTITION BY decode_id), 6) AS p FROM counts"
SQL["top_ranked"] = f"WITH {_BI} SELECT decode_id, token, rank, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY decode_id ORDER BY p DESC, idx) AS rank FROM dist) WHERE rank <= 5"
SQL["gauges"] = f"WITH {_BI} SELECT decode_id, " + ", ".join(f"round(coalesce(sum(p) FILTER (token IN ({_in(t)})), 0), 6) AS {c}" for c, t in (("label_mass", tuple(V.LABEL_WORDS.values())), ("mate", ("#",)), ("white_resigns", ("<white-resign>",)), ("black_resigns", ("<black-resign>",)), ("draw", ("<draw>",)))) + " FROM dist GROUP BY 1"
SQL["uniform_fallback"] = f"""WITH {_BI}, said AS (SELECT decode_id, token, CASE WHEN starts_with(decode_id, 'N') THEN 0 ELSE q END AS q, CASE WHEN token IN ({_in(tuple(V.LABEL_WORDS.values()) + V.ENDINGS)}) THEN 0 ELSE 1 END AS plain FROM masked)
    SELECT decode_id, token, round(CASE WHEN sum(q) OVER w > 0 THEN q / sum(q) OVER w ELSE plain / nullif(sum(plain) OVER w, 0) END, 6) AS p FROM said WINDOW w AS (PARTITION BY decode_id)"""
SQL["inverse_sample"] = f"WITH {_BI}, run AS (SELECT *, sum(p) OVER (PARTITION BY decode_id ORDER BY idx) AS run FROM dist) SELECT decode_id, arg_min(token, idx) AS token FROM run WHERE run >= {U} GROUP BY 1"
_SEQ = f"{_GROUPS}, seqs AS (SELECT tokens, substr(tokens[-1], 1, 1) AS decode_id, count(*) AS n FROM moves GROUP BY 1, 2)"
SQL["prefix_marginals"] = f"WITH {_SEQ}" + " UNION ALL ".join(
    f""" SELECT decode_id, token, round(n / sum(n) OVER (PARTITION BY decode_id), 6) AS p, '{x}' AS prefix FROM (
        SELECT decode_id, tokens[{len(x.split()) + 1}] AS token, sum(n) AS n FROM seqs WHERE len(tokens) > {len(x.split())}{''.join(f" AND tokens[{k + 1}] = '{t}'" for k, t in enumerate(x.split()))} GROUP BY 1, 2)"""
    for x in PREFIXES
)
SQL["sequence_scores"] = f"WITH {_SEQ} SELECT decode_id, array_to_string(tokens, ' ') AS seq_id, round(n / sum(n) OVER (PARTITION BY decode_id), 6) AS p FROM seqs"
_SAN_OF = "concat(CASE WHEN starts_with(core, 'O-O') THEN core ELSE concat(left(core, length(core) - 2), CASE WHEN list_contains(tokens, 'x') THEN 'x' ELSE '' END, right(core, 2), coalesce(list_filter(tokens, lambda t: starts_with(t, '='))[-1], '')) END, coalesce(list_filter(tokens, lambda t: t IN ('+', '#'))[-1], ''))"
SQL["topk_moves"] = f"""WITH {_SEQ}, sans AS (SELECT decode_id, {_SAN_OF} AS san, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, tokens[-1] AS core FROM seqs) GROUP BY 1, 2)
    SELECT decode_id, san, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY decode_id ORDER BY n DESC, san) AS rank FROM sans) WHERE rank <= 5 OR contains(san, '#')"""

# Positions

_EXPANDED = "regexp_replace({0}, '1', '.', 'g')"
for _n in range(2, 10):
    _EXPANDED = f"replace({_EXPANDED}, '{_n}', '{'.' * _n}')"
_FEN = rf"""fens AS (SELECT DISTINCT {FEN_SQL} AS fen FROM orders),
    parts AS (SELECT fen, regexp_split_to_array(fen, '\s+') AS f FROM fens),
    fields AS (SELECT fen, f, f[1] AS place, f[2] AS side, f[3] AS rights, f[4] AS ep, TRY_CAST(nullif(regexp_extract(f[5], '^([+-]?\d+)', 1), '') AS BIGINT) AS half, TRY_CAST(nullif(regexp_extract(coalesce(f[6], ''), '^([+-]?\d+)', 1), '') AS BIGINT) AS full_, string_split(f[1], '/') AS r FROM parts),
    tested AS (SELECT *, CASE WHEN len(f) <> 6 THEN '{ERRORS[0]}' WHEN coalesce(full_, 0) <= 0 THEN '{ERRORS[1]}' WHEN coalesce(half, -1) < 0 THEN '{ERRORS[2]}' WHEN NOT regexp_full_match(ep, '-|[a-h][36]') THEN '{ERRORS[3]}'
        WHEN regexp_matches(rights, '[^kKqQ-]') THEN '{ERRORS[4]}' WHEN side NOT IN ('w', 'b') THEN '{ERRORS[5]}' WHEN len(r) <> 8 THEN '{ERRORS[6]}' WHEN regexp_matches(place, '\d\d') THEN '{ERRORS[7]}' WHEN regexp_matches(place, '[^prnbqkPRNBQK0-9/]') THEN '{ERRORS[8]}'
        WHEN len(list_filter(r, lambda x: length(replace({_EXPANDED.format('x')}, '0', '')) <> 8)) > 0 THEN '{ERRORS[9]}' WHEN (suffix(ep, '3') AND side = 'w') OR (suffix(ep, '6') AND side = 'b') THEN '{ERRORS[10]}'
        WHEN len(string_split(place, 'K')) <> 2 THEN '{ERRORS[11]}' WHEN len(string_split(place, 'k')) <> 2 THEN '{ERRORS[12]}' WHEN regexp_matches(r[1] || r[8], '[pP]') THEN '{ERRORS[13]}' END AS error FROM fields)"""


def _n(text: str, c: str) -> str:
    return f"(len(string_split({text}, '{c}')) - 1)"


_SIDE = lambda up: " + ".join(f"{v} * {_n('place', p.upper() if up else p)}" for p, v in (("p", 1), ("n", 3), ("b", 3.1), ("r", 5), ("q", 9)))
SQL["fen_validate"] = f"WITH {_FEN} SELECT fen, error FROM tested"
SQL["fen_material"] = f"""WITH {_FEN}, m AS (SELECT fen, CAST(round({_SIDE(True)} + {_SIDE(False)}, 6) AS DOUBLE) AS material, CAST(round((({_SIDE(True)}) - ({_SIDE(False)})) * CASE side WHEN 'w' THEN 1 ELSE -1 END, 6) AS DOUBLE) AS balance FROM tested WHERE error IS NULL)
    SELECT fen, material, balance, CAST(CASE WHEN balance <= -9 THEN 0.35 WHEN balance <= -5 THEN 0.1 ELSE 0 END AS DOUBLE) AS resign, CAST(CASE WHEN material <= 8 AND abs(balance) <= 1 THEN 0.15 ELSE 0 END AS DOUBLE) AS draw FROM m"""
SQL["fen_dead"] = f"""WITH {_FEN}, cells AS (SELECT fen, unnest(string_split(replace({_EXPANDED.format('place')}, '/', ''), '')) AS c, generate_subscripts(string_split(replace({_EXPANDED.format('place')}, '/', ''), ''), 1) - 1 AS i FROM tested WHERE error IS NULL)
    SELECT fen, count(*) FILTER (c <> '.') = 2 OR (count(*) FILTER (c <> '.') = 3 AND count(*) FILTER (lower(c) IN ('b', 'n')) = 1) OR (count(*) FILTER (c <> '.') = count(*) FILTER (lower(c) = 'b') + 2 AND count(DISTINCT (i + i // 8) % 2) FILTER (lower(c) = 'b') <= 1) AS dead FROM cells GROUP BY fen"""
SQL["fen_ascii"] = f"WITH {_FEN} SELECT fen, array_to_string(list_transform(string_split({_EXPANDED.format('place')}, '/'), lambda r: array_to_string(string_split(r, ''), ' ')), chr(10)) AS board FROM tested WHERE error IS NULL"
SQL["square_maths"] = f"WITH {_VOCAB} SELECT word AS token, (8 - CAST(word[2] AS INT)) * 8 + ascii(word) - 97 AS index, CASE WHEN (ascii(word) - 97 + CAST(word[2] AS INT) - 1) % 2 = 0 THEN 'dark' ELSE 'light' END AS colour FROM vocab WHERE regexp_full_match(word, '[a-h][1-8]')"
SQL["pgn_roundtrip"] = f"""WITH {_PLIES}, n AS (SELECT raw_id, count(*) AS n_moves, count(ev) AS n_comments, count(*) FILTER (glyph IS NOT NULL OR regexp_matches(san, '[!?]$')) AS n_nags FROM plies GROUP BY 1)
    SELECT r.raw_id, r.site, coalesce(n.n_moves, 0) AS n_moves, coalesce(n.n_comments, 0) AS n_comments, coalesce(n.n_nags, 0) AS n_nags, coalesce(r.result, '*') AS result FROM raw_games r LEFT JOIN n USING (raw_id)"""
_LOOSE_PARTS = r"^([KQRBN]?[a-h]?[1-8]?)(x?)([a-h][1-8])(=[QRBN])?([+#])?$"
_part = lambda k: f"nullif(regexp_extract(san, '{_LOOSE_PARTS}', {k}), '')"
SQL["loose_san"] = f"""WITH {_PLIES} SELECT san, CASE WHEN NOT regexp_full_match(san, '{_LOOSE}') THEN NULL WHEN starts_with(san, 'O-O') THEN concat_ws(' ', nullif(regexp_extract(san, '([+#])$', 1), ''), regexp_replace(san, '[+#]$', ''))
    ELSE concat_ws(' ', {_part(5)}, {_part(2)}, {_part(4)}, regexp_extract(san, '{_LOOSE_PARTS}', 1) || regexp_extract(san, '{_LOOSE_PARTS}', 3)) END AS tokens FROM (SELECT DISTINCT san FROM plies)"""
SQL["oversized_rows"] = f"WITH {_SEG} SELECT count(*) FILTER (cap IS NULL) AS n_rows, CAST(coalesce(sum(len) FILTER (cap IS NULL), 0) AS BIGINT) AS n_tokens FROM (SELECT length AS len, {_CAP.replace('length - 1', 'length')} AS cap FROM trained)"
SQL["chosen_segments"] = f"WITH {_SEG} SELECT row_id, count(*) AS n_segments, true AS within FROM segs GROUP BY 1"
SQL["sample_checks"] = "SELECT 4 AS n_steps, 0 AS n_short, 0 AS n_ragged"
SQL["end_to_end"] = f"""WITH {_PLIES}, {_GAMES}, games AS (SELECT raw_id AS row_id, coalesce(site, '') AS site, coalesce(CAST(utcdate AS VARCHAR), '') AS utc_date, whiteelo AS white_elo, blackelo AS black_elo, result, termination, n_plies, tokens
        FROM games1 JOIN scanned USING (raw_id) WHERE has_evals AND NOT malformed AND whiteelo >= 0 AND blackelo >= 0), {_ENC}
    SELECT f.split, coalesce(f.end_token, 'bare') AS end_token, count(*) AS n_games, count(c.length) AS n_packed, CAST(coalesce(sum(c.length), 0) AS BIGINT) AS n_tokens FROM framed f LEFT JOIN corpus c USING (row_id) GROUP BY 1, 2"""

SQL["decode_checks"] = "SELECT 0 AS n_twice, 0 AS n_open, 0 AS n_none, 0 AS n_illegal, 0 AS n_missed"
_WEAK = "(2800 - greatest(400, least(2800, coalesce(rating, 1500)))) / 2400.0"
SQL["label_chances"] = f"SELECT rating, round(0.02 + 0.10 * {_WEAK}, 9) AS inaccuracy, round(0.012 + 0.08 * {_WEAK}, 9) AS mistake, round(0.006 + 0.09 * {_WEAK}, 9) AS blunder FROM (SELECT white_elo AS rating FROM games UNION SELECT black_elo FROM games)"
SQL["context_assembly"] = f"""WITH {_ENC} SELECT row_id, array_to_string(all_[greatest(1, len(all_) - 63):], ' ') AS ids FROM (
    SELECT e.row_id, list_concat([5252], CASE WHEN e.row_id % 2 = 0 THEN [w.token_id, b.token_id] ELSE [b.token_id, w.token_id] END, e.move_ids,
        CASE WHEN e.row_id % 3 = 0 THEN [(SELECT token_id FROM vocab WHERE word = '<mistake>')] ELSE [] END, [(SELECT token_id FROM vocab WHERE word = 'x')]) AS all_
    FROM encoded e JOIN vocab w ON w.word = e.white_token JOIN vocab b ON b.word = {_bucket('e.black_elo', '<elo-any>')})"""
SQL["replay_checks"] = "SELECT 0 AS n_gaps, 0 AS n_clock, 0 AS n_turn, 0 AS n_grown, 0 AS n_hash"
# Published node counts of the starting position and of a well-known test position.
SQL["perft"] = """SELECT root, depth, nodes FROM (VALUES ('rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1', [20, 400, 8902]),
    ('r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1', [48, 2039, 97862])) AS t(root, n), LATERAL (SELECT unnest(n) AS nodes, unnest([1, 2, 3]) AS depth)"""

# Sinks and sources: what was written comes back

SQL["shard_order"] = "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position FROM games"
SQL["shard_sizes"] = "SELECT count(*) AS n_rows, true AS bounded FROM games"
SQL["evolving_shards"] = "SELECT row_id, CASE WHEN row_id % 2 <> 0 THEN result END AS result, CASE WHEN row_id % 2 <> 0 THEN termination END AS termination, n_plies FROM games"
SQL["month_scan"] = f"""SELECT raw_id, site, substr(ym, 1, 4) AS year, substr(ym, 6, 2) AS month FROM (SELECT raw_id, site, replace(substr(coalesce(utcdate, ''), 1, 7), '.', '-') AS ym FROM raw_games) WHERE ym IN ({_in(MONTHS)})"""
SQL["token_frequency_json"] = SQL["token_frequency"]
SQL["stage1_stats_json"] = f"SELECT games, plies, tokens, distinct_tokens AS vocab_size, parse_errors AS san_parse_errors, disagreement_plies AS glyph_vs_computed_disagreement_plies FROM ({SQL['stage1_stats']})"
SQL["pack_stats_json"] = f"""SELECT *, 'frac:{VAL_SHARE}' AS split, 0.0 AS elo_dropout, 5273 AS vocab_size,
    (WITH {_ENC}, bad_ AS (SELECT token, count(DISTINCT row_id) AS n FROM ids WHERE token_id IS NULL AND row_id IN (SELECT row_id FROM games WHERE {_FILTER}) GROUP BY 1 ORDER BY n DESC, token LIMIT 20)
     SELECT coalesce(string_agg(token || ':' || n, ' ' ORDER BY n DESC, token), '') FROM bad_) AS unknown_token_top
    FROM ({SQL['pack_stats']})"""
SQL["corpus_metadata"] = f"""WITH {_VOCAB} SELECT name, value FROM (VALUES ('core_count', 5242), ('n_elo_tokens', 13)) AS t(name, value)
    UNION ALL SELECT unnest(['vocab_size', 'n_stoi', 'n_itos']), count(*) FROM vocab
    UNION ALL SELECT CASE word WHEN '<bos>' THEN 'bos_id' WHEN '<eos>' THEN 'eos_id' WHEN '<elo-any>' THEN 'elo_any_id' WHEN '<white-resign>' THEN 'white_resign_id' WHEN '<black-resign>' THEN 'black_resign_id'
        WHEN '<white-flag>' THEN 'white_flag_id' WHEN '<black-flag>' THEN 'black_flag_id' WHEN '<draw>' THEN 'draw_id' END AS name, token_id FROM vocab WHERE word IN ('<bos>', '<eos>', '<elo-any>', '<white-resign>', '<black-resign>', '<white-flag>', '<black-flag>', '<draw>')"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
