"""SQL for the queries, over the same derived inputs."""

VIEWS = r"""
    docs AS (SELECT doc_id AS tid, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
    spread AS (SELECT tid, unnest(w) AS word, CAST(unnest(range(len(w))) AS BIGINT) AS i FROM docs),
    timed AS (
        SELECT *, 80 + 60 * least(length(word), 12) AS len_ms,
               CASE WHEN regexp_matches(word, '[.!?]$') THEN 300 + (7919 * i + 31 * tid) % 2400 WHEN word LIKE '%,' THEN 50 + (7919 * i + 31 * tid) % 600
                    WHEN i % 53 = 52 THEN -40 ELSE (104729 * i + 17 * tid) % 450 END AS gap_ms
        FROM spread),
    clocked AS (SELECT *, CAST(coalesce(sum(len_ms + gap_ms) OVER (PARTITION BY tid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ms FROM timed),
    words AS (SELECT tid, CAST(i AS INTEGER) AS idx, word, ms / 1000::DOUBLE AS t0, (ms + len_ms) / 1000::DOUBLE AS t1 FROM clocked),
    candidates AS (
        SELECT tid, CAST(i // 37 AS INTEGER) AS ord, (ms + (13 * i) % 900) / 1000::DOUBLE AS t_start,
               (ms + (13 * i) % 900 + 10000 + (7919 * tid + 104729 * i) % 60000) / 1000::DOUBLE AS t_end,
               CAST((31 * tid + 17 * i) % 101 AS INTEGER) AS score, 'hook ' || (i // 37) AS hook, word AS title, 'about' AS description, CAST(i // 400 AS INTEGER) AS chunk_no
        FROM clocked WHERE i % 37 = 0)"""

#: Columns on words.
SENTENCE_END, MIDPHRASE = "regexp_matches(word, '[.!?…]$')", "regexp_matches(word, '[,;:—–-]$')"
HANG = r"""lower(regexp_replace(word, '^[.!?…,;:"''»«()—–\-]+|[.!?…,;:"''»«()—–\-]+$', '', 'g')) IN ('the', 'and', 'de', 'la', 'und', 'que', 'en', 'le')"""

SENTENCES = r"""
    flagged AS (SELECT *, CASE WHEN regexp_matches(word, '[.!?…][»"'')\]]*$') OR coalesce(lead(t0) OVER w - t1 > 0.35::DOUBLE, false) THEN 1 ELSE 0 END AS b FROM words WINDOW w AS (PARTITION BY tid ORDER BY idx)),
    numbered AS (SELECT * EXCLUDE (b), CAST(coalesce(sum(b) OVER (PARTITION BY tid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS sent_no FROM flagged),
    sentences AS (
        SELECT tid, sent_no, arg_min(t0, idx) AS t0, arg_max(t1, idx) AS t1, string_agg(word, ' ' ORDER BY idx) AS text, CAST(count(*) AS INTEGER) AS n_words
        FROM numbered GROUP BY tid, sent_no)"""

MARKS = f"""
    marks AS (
        SELECT *, {SENTENCE_END} AS sentence_end, {MIDPHRASE} AS midphrase, {HANG} AS hanging, lead(t0) OVER w - t1 AS gap,
               lag(word) OVER w AS last_word, lag(t1) OVER w AS last_t1, lead(t0) OVER w AS next_t0
        FROM words WINDOW w AS (PARTITION BY tid ORDER BY idx)),
    phrases AS (
        SELECT *, sentence_end OR (NOT midphrase AND (gap IS NULL OR (gap > 0.4::DOUBLE AND gap > 1.5::DOUBLE)) AND NOT hanging) AS phrase_end,
               sentence_end OR (NOT midphrase AND (gap IS NULL OR gap > 0.4::DOUBLE) AND NOT hanging) AS soft_end,
               last_word IS NULL OR regexp_matches(last_word, '[.!?…]$') OR (t0 - last_t1 > 1.5::DOUBLE AND NOT regexp_matches(last_word, '[,;:—–-]$')) AS phrase_start,
               min(CASE WHEN NOT hanging THEN idx END) OVER (PARTITION BY tid ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_clean
        FROM marks)"""


def stamp(column: str, mark: str) -> str:
    ms = f"CAST(round_even({column} * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def cues(fmt: str) -> str:
    mark, head = (",", "''") if fmt == "srt" else (".", "'WEBVTT' || chr(10) || chr(10)")
    return f"""WITH {VIEWS}, {SENTENCES}
        SELECT tid, {head} || string_agg((sent_no + 1) || chr(10) || {stamp('t0', mark)} || ' --> ' || {stamp('t1', mark)} || chr(10) || text, chr(10) || chr(10) ORDER BY sent_no) || chr(10) AS text
        FROM sentences GROUP BY tid"""


def greedy(source: str, order: str) -> str:
    """CTEs that leave `kept`: (tid, k) of the segments of `source` that greedy de-duplication in that order keeps."""
    return f"""
    placed AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY {order}) AS k FROM {source}),
    walk AS (
        SELECT tid, CAST(1 AS BIGINT) AS k, [(t_start, t_end)] AS held, true AS taken FROM placed WHERE k = 1
        UNION ALL
        SELECT w.tid, p.k, CASE WHEN bad THEN held ELSE list_append(held, (p.t_start, p.t_end)) END, NOT bad
        FROM walk w JOIN placed p ON p.tid = w.tid AND p.k = w.k + 1,
             LATERAL (SELECT len(list_filter(held, lambda h: CASE WHEN least(p.t_end - p.t_start, h[2] - h[1]) > 0
                 THEN greatest(0::DOUBLE, least(p.t_end, h[2]) - greatest(p.t_start, h[1])) / least(p.t_end - p.t_start, h[2] - h[1]) ELSE 0 END > 0.5::DOUBLE)) > 0 AS bad) x),
    kept AS (SELECT p.* FROM walk w JOIN placed p ON p.tid = w.tid AND p.k = w.k WHERE taken)"""


SQL: dict[str, str] = {
    "b1_word_class": f"WITH {VIEWS} SELECT tid, idx, word, {SENTENCE_END} AS sentence_end, {MIDPHRASE} AS midphrase, {HANG} AS hanging FROM words",
    "e1_split_sentences": f"WITH {VIEWS}, {SENTENCES} SELECT tid, sent_no, t0, t1, n_words FROM sentences",
    "d1_compressed_lines": f"WITH {VIEWS}, {SENTENCES} SELECT tid, sent_no, '[' || printf('%06.1f', t0) || '-' || printf('%06.1f', t1) || '] ' || text AS line FROM sentences",
    "b5_token_estimate": f"WITH {VIEWS}, {SENTENCES} SELECT tid, sent_no, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM sentences",
    "d2_paragraph_text": f"""WITH {VIEWS}, {SENTENCES},
        gaps AS (SELECT *, lag(t1) OVER (PARTITION BY tid ORDER BY sent_no) AS p FROM sentences)
        SELECT tid, string_agg(CASE WHEN p IS NULL THEN '' WHEN t0 - p > 1.75::DOUBLE THEN chr(10) || chr(10) ELSE ' ' END || text, '' ORDER BY sent_no) AS text FROM gaps GROUP BY tid""",
    "d3_cue_track_srt": cues("srt"), "d3_cue_track_vtt": cues("vtt"),
    "d4_word_json": f"""WITH {VIEWS} SELECT tid, '[' || string_agg('{{"word":' || to_json(word) || ',"t0":' || to_json(t0) || ',"t1":' || to_json(t1) || '}}', ',' ORDER BY idx) || ']' AS text FROM words GROUP BY tid""",
    "e2_phrase_ends": f"WITH {VIEWS}, {MARKS} SELECT tid, idx, phrase_end FROM phrases",
    "e3_phrase_starts": f"WITH {VIEWS}, {MARKS} SELECT tid, idx, phrase_start, next_clean FROM phrases",
    "e4_pause_ends": f"WITH {VIEWS}, {MARKS} SELECT tid, idx, gap IS NULL OR gap > 0.35::DOUBLE AS pause_end FROM phrases",
    "b2_flag_durations": f"""WITH {VIEWS} SELECT tid, ord, CASE WHEN t_end - t_start < 15 THEN 'too_short' WHEN t_end - t_start > 59 THEN 'too_long' ELSE '' END AS flags FROM candidates""",
    "b3_filter_by_score": f"WITH {VIEWS} SELECT tid, ord, score FROM candidates WHERE score >= 65",
    "b4_filter_by_duration": f"WITH {VIEWS} SELECT tid, ord, t_start, t_end FROM candidates WHERE t_end - t_start >= 18",
    "e9_dedup_by_score": f"WITH RECURSIVE {VIEWS}, {greedy('candidates', 'score DESC, ord')} SELECT tid, ord, t_start, t_end, score FROM kept",
    "e10_dedup_by_start": f"WITH RECURSIVE {VIEWS}, {greedy('candidates', 't_start, ord')} SELECT tid, ord, t_start, t_end, score FROM kept",
    "e11_rank_and_number": f"""WITH {VIEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY score DESC, ord) AS n FROM candidates)
        SELECT tid, ord, CAST(n AS INTEGER) AS rank, 'r' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS seg_id FROM r""",
}
_ANSWERS = f"""
    good AS (SELECT * FROM candidates WHERE tid % 11 <> 3 AND tid % 13 <> 5 AND tid % 17 <> 7 AND tid % 29 <> 9),
    answered AS (SELECT DISTINCT tid, chunk_no FROM candidates),
    passed AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY tid ORDER BY ord) - 1 AS INTEGER) AS ord) FROM good WHERE score >= 65 AND t_end - t_start >= 18)"""
SQL |= {
    "b7_parse_candidates": f"""WITH {VIEWS}, {_ANSWERS} SELECT tid, chunk_no, CAST(row_number() OVER (PARTITION BY tid, chunk_no ORDER BY ord) - 1 AS INTEGER) AS pos, t_start, t_end, score, hook, title, description, '' AS reason, '' AS topic FROM good""",
    "b7_quarantined": f"""WITH {VIEWS}, {_ANSWERS} SELECT tid, chunk_no, CASE WHEN tid % 11 = 3 THEN 'invalid_json' WHEN tid % 13 = 5 THEN 'empty' WHEN tid % 17 = 7 THEN 'no_segments' ELSE 'empty' END AS reason
        FROM answered WHERE tid % 11 = 3 OR tid % 13 = 5 OR tid % 17 = 7 OR tid % 29 = 9""",
    "f1_union_chunk_candidates": f"WITH {VIEWS}, {_ANSWERS} SELECT tid, ord, t_start, t_end, score FROM passed",
    "h4_select_pipeline": f"""WITH RECURSIVE {VIEWS}, {SENTENCES}, {_ANSWERS},
        sizes AS (SELECT tid, greatest(1, length(string_agg('[' || printf('%06.1f', t0) || '-' || printf('%06.1f', t1) || '] ' || text, chr(10))) // 4) > 4000 AS large FROM sentences GROUP BY tid),
        pooled AS (SELECT p.*, CASE WHEN large THEN t_start ELSE -score END AS key FROM passed p JOIN sizes s ON p.tid = s.tid),
        {greedy('pooled', 'key, ord')},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY score DESC, ord) AS n FROM kept)
        SELECT tid, 'r' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS seg_id, t_start, t_end, score FROM ranked""",
}

_FLAGGED = f"""{MARKS},
    edged AS (
        SELECT *, last_value(t0) OVER w AS last_t0, last_value(t1) OVER w AS speech_end,
               first_value(CASE WHEN NOT hanging THEN t0 END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS clean_t0
        FROM phrases WINDOW w AS (PARTITION BY tid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def starts(source: str) -> str:
    return f"""
    near_start AS (
        SELECT c.tid, c.ord, any_value(c.t_start) AS t_start, any_value(c.t_end) AS t_end,
               coalesce(arg_min({{'t0': t0, 'clean': clean_t0, 'last': last_t0}}, (abs(t0 - c.t_start), idx)) FILTER (WHERE phrase_start),
                        arg_min({{'t0': t0, 'clean': clean_t0, 'last': last_t0}}, (abs(t0 - c.t_start), idx)) FILTER (WHERE idx IS NOT NULL)) AS x
        FROM {source} c LEFT JOIN edged e ON e.tid = c.tid AND abs(t0 - c.t_start) <= 1.5::DOUBLE GROUP BY c.tid, c.ord),
    aimed AS (SELECT *, CASE WHEN x.clean IS NOT NULL THEN x.clean WHEN x.last < t_end THEN x.t0 END AS aim FROM near_start),
    started AS (SELECT tid, ord, CASE WHEN aim < t_end THEN aim ELSE t_start END AS t_start, t_end FROM aimed)"""


ENDS = """
    near_end AS (
        SELECT c.tid, c.ord, any_value(c.t_start) AS s, any_value(c.t_end) AS e, any_value(c.t_start) + 59 AS lim,
               min(t1) FILTER (WHERE phrase_end AND t1 >= c.t_end - 1.5::DOUBLE) AS fwd, max(t1) FILTER (WHERE phrase_end) AS wit,
               min(t1) FILTER (WHERE soft_end AND t1 >= c.t_end - 1.5::DOUBLE) AS sfwd, max(t1) FILTER (WHERE soft_end) AS swit,
               arg_max(t1, (gap, -idx)) FILTER (WHERE gap > -1 AND NOT midphrase AND NOT hanging) AS wide,
               arg_min(t1, (abs(t1 - c.t_end), idx)) FILTER (WHERE NOT midphrase AND NOT hanging AND abs(t1 - c.t_end) <= 1.5::DOUBLE) AS cnear,
               max(t1) FILTER (WHERE NOT midphrase AND NOT hanging) AS clast, arg_min(t1, (abs(t1 - c.t_end), idx)) FILTER (WHERE abs(t1 - c.t_end) <= 1.5::DOUBLE) AS near,
               list(t1 ORDER BY t1) FILTER (WHERE sentence_end) AS stops
        FROM started c LEFT JOIN edged p ON p.tid = c.tid AND t1 > c.t_start AND t1 <= c.t_start + 59 GROUP BY c.tid, c.ord),
    once AS (SELECT *, CASE WHEN fwd + 0.3::DOUBLE - s < 0.7::DOUBLE * (lim - s) THEN coalesce(list_filter(stops, lambda t: t > fwd + 1e-6::DOUBLE)[1], fwd) ELSE fwd END AS f1 FROM near_end),
    twice AS (SELECT *, CASE WHEN f1 + 0.3::DOUBLE - s < 0.7::DOUBLE * (lim - s) THEN coalesce(list_filter(stops, lambda t: t > f1 + 1e-6::DOUBLE)[1], f1) ELSE f1 END AS f2 FROM once),
    snapped AS (
        SELECT tid, ord, s AS t_start, CASE WHEN chosen IS NOT NULL AND least(chosen + 0.3::DOUBLE, lim) > s THEN least(chosen + 0.3::DOUBLE, lim) ELSE e END AS t_end
        FROM (SELECT *, coalesce(f2, wit, sfwd, swit, wide, cnear, clast, near) AS chosen FROM twice))"""


def padding(source: str) -> str:
    return f"""
    inner_ AS (
        SELECT c.tid, c.ord, any_value(c.t_start) AS s0, any_value(c.t_end) AS e0, list({{'t0': t0, 't1': t1, 'se': sentence_end, 'mid': midphrase, 'hang': hanging, 'p': last_t1, 'n': next_t0, 'end_': speech_end}} ORDER BY idx) FILTER (WHERE idx IS NOT NULL) AS a
        FROM {source} c LEFT JOIN edged w ON w.tid = c.tid AND t0 >= c.t_start AND t0 < c.t_end GROUP BY c.tid, c.ord),
    stop_ AS (SELECT *, list_max(list_filter(range(1, len(a) + 1), lambda k: a[k].se)) AS st FROM inner_),
    spill_ AS (SELECT *, CASE WHEN st IS NOT NULL AND len(list_filter(range(st + 1, len(a) + 1), lambda k: a[k].t0 - a[st].t1 > 0.4::DOUBLE)) = 0 THEN st ELSE len(a) END AS kept FROM stop_),
    tail_ AS (SELECT *, list_max(list_filter(range(1, kept + 1), lambda k: k = 1 OR NOT (NOT a[k].se AND (a[k - 1].se OR a[k].hang OR a[k].mid)))) AS n FROM spill_),
    lead_ AS (SELECT *, least(greatest(0::DOUBLE, a[1].t0 - 0.3::DOUBLE, coalesce(a[1].p + 0.05::DOUBLE, 0::DOUBLE)), a[1].t0) AS s FROM tail_),
    padded AS (
        SELECT tid, ord, CASE WHEN a IS NULL THEN s0 ELSE s END AS t_start,
               CASE WHEN a IS NULL THEN e0 ELSE least(greatest(least(a[n].t1 + 0.7::DOUBLE, coalesce(a[n].n - 0.05::DOUBLE, a[n].t1 + 0.7::DOUBLE)), a[n].t1), s + 59, a[n].end_) END AS t_end
        FROM lead_)"""


def trimming(source: str) -> str:
    """source: with a column long, whether it was flagged. Words meet the segments of their transcript by minute."""
    return f"""
    asked_ AS MATERIALIZED (SELECT tid, ord, t_start, unnest(range(CAST(floor(t_start / 60) AS BIGINT), CAST(floor((t_start + 60) / 60) AS BIGINT) + 1)) AS minute FROM {source} WHERE long),
    said_ AS MATERIALIZED (SELECT tid, idx, t0, t1, CAST(floor(t0 / 60) AS BIGINT) AS minute FROM words),
    inside_ AS (
        SELECT c.tid, c.ord, t_start, t1, lead(t0) OVER (PARTITION BY c.tid, c.ord ORDER BY idx) AS next_t0
        FROM asked_ c JOIN said_ w ON w.tid = c.tid AND w.minute = c.minute WHERE t0 >= t_start AND t1 <= t_start + 59 + 1),
    stops_ AS (
        SELECT tid, ord, max(t1) FILTER (WHERE next_t0 IS NULL OR next_t0 - t1 > 0.35::DOUBLE) AS pause, max(t1) AS word
        FROM inside_ WHERE t1 <= t_start + 59 GROUP BY tid, ord),
    trimmed AS (
        SELECT c.tid, c.ord, t_start, long, CASE WHEN NOT long THEN t_end ELSE coalesce(pause, word, t_start + 59) END AS t_end
        FROM {source} c LEFT JOIN stops_ w ON w.tid = c.tid AND w.ord = c.ord)"""


_CLASSES = """
    lasts AS (
        SELECT c.tid, c.ord, any_value(c.t_start) AS s, any_value(c.t_end) AS e,
               list({'word': word, 't0': t0, 't1': t1, 'se': sentence_end, 'mid': midphrase, 'hang': hanging} ORDER BY idx) FILTER (WHERE t1 <= c.t_end + 0.05::DOUBLE) AS a,
               max(t1) FILTER (WHERE phrase_end AND t1 <= c.t_end + 0.05::DOUBLE) AS pe
        FROM candidates c LEFT JOIN edged w ON w.tid = c.tid GROUP BY c.tid, c.ord),
    walked AS (SELECT *, a[list_max(list_filter(range(1, len(a) + 1), lambda k: k = 1 OR NOT (a[k].t0 < a[k - 1].t1 AND a[k - 1].se)))] AS w FROM lasts),
    next_ AS (
        SELECT k.tid, k.ord, arg_min(t0, idx) AS nt FROM walked k JOIN words n ON n.tid = k.tid AND n.t0 > k.w.t1 + 0.001::DOUBLE GROUP BY k.tid, k.ord),
    gaps_ AS (SELECT k.*, CAST(printf('%.2f', nt - w.t1) AS DOUBLE) AS gap FROM walked k LEFT JOIN next_ n ON n.tid = k.tid AND n.ord = k.ord),
    typed AS (
        SELECT *, CASE WHEN w IS NULL THEN 'нет слов' WHEN w.se THEN 'фраза(.!?)' WHEN gap IS NULL THEN 'конец речи' WHEN w.mid THEN 'запятая' WHEN w.hang THEN 'висячее'
                       WHEN gap >= 1.5::DOUBLE THEN 'пауза≥1.5' WHEN gap < 0.4::DOUBLE THEN 'мид-слово' ELSE 'пауза' END AS end_type FROM gaps_),
    ends AS (
        SELECT tid, ord, CAST(printf('%.1f', e - s) AS DOUBLE) AS duration, coalesce(array_to_string(list_transform(a[greatest(1, len(a) - 4):], lambda x: x.word), ' '), '') AS last_words,
               end_type, gap AS pause_after,
               CASE WHEN end_type IN ('нет слов', 'запятая', 'висячее', 'мид-слово') THEN 'HARD' WHEN end_type = 'пауза' THEN 'SOFT' ELSE 'CLEAN' END AS verdict,
               CASE WHEN end_type NOT IN ('нет слов', 'запятая', 'висячее', 'мид-слово') THEN '' WHEN end_type = 'нет слов' THEN 'нет слов в клипе'
                    WHEN e - pe > 0.05::DOUBLE AND e - pe <= 0.7::DOUBLE + 0.35::DOUBLE THEN 'PAD-хвост +' || printf('%.2f', e - pe) || 'с'
                    WHEN end_type IN ('запятая', 'висячее') THEN end_type || ' (snap-fallback)' ELSE 'snap-fallback (нет чистой границы)' END AS cause
        FROM typed)"""
_LONG = "SELECT p.tid, p.ord, p.t_start, p.t_end, c.t_end - c.t_start > 59 AS long FROM padded p JOIN {0} c ON c.tid = p.tid AND c.ord = p.ord"
_PICKED = SQL["h4_select_pipeline"].split("SELECT tid, 'r'")[0].rstrip()
SQL |= {
    "c1_words_in_segment": f"""WITH {VIEWS} SELECT c.tid, c.ord, count(word) AS n, coalesce(string_agg(word, ' ' ORDER BY idx), '') AS text
        FROM candidates c LEFT JOIN words w ON w.tid = c.tid AND t0 >= t_start AND t0 < t_end GROUP BY c.tid, c.ord""",
    "c3_snap_start": f"WITH {VIEWS}, {_FLAGGED}, {starts('candidates')} SELECT * FROM started",
    "c4_snap_end": f"WITH {VIEWS}, {_FLAGGED}, {starts('candidates')}, {ENDS} SELECT * FROM snapped",
    "c7_apply_padding": f"WITH {VIEWS}, {_FLAGGED}, {padding('candidates')} SELECT * FROM padded",
    "c8_trim_too_long": f"""WITH {VIEWS}, longs AS (SELECT tid, ord, t_start, t_end, t_end - t_start > 59 AS long FROM candidates), {trimming('longs')}
        SELECT t.tid, t.ord, t.t_start, t.t_end, CASE WHEN c.t_end - c.t_start < 15 THEN 'too_short' ELSE '' END AS flags FROM trimmed t JOIN candidates c ON c.tid = t.tid AND c.ord = t.ord""",
    "h1_classify_end": f"WITH {VIEWS}, {_FLAGGED}, {_CLASSES} SELECT * FROM ends",
    "d7_end_quality_summary": f"""WITH {VIEWS}, {_FLAGGED}, {_CLASSES}, short AS (SELECT tid, verdict, split_part(cause, ' +', 1) AS cause FROM ends)
        SELECT tid, verdict, cause, count(*) AS n FROM short GROUP BY GROUPING SETS ((tid, verdict, cause), (verdict, cause))""",
    "h5_segment_pipeline": f"""{_PICKED}, picked AS (SELECT * FROM ranked), {_FLAGGED}, {starts('picked')}, {ENDS}, {padding('snapped')}, longs AS ({_LONG.format('picked')}), {trimming('longs')}
        SELECT p.tid, 'r' || CASE WHEN p.n < 10 THEN '0' ELSE '' END || p.n AS seg_id, p.t_start AS r0_start, p.t_end AS r0_end, t.t_start, t.t_end,
               (SELECT count(*) FROM words w WHERE w.tid = t.tid AND w.t0 >= t.t_start AND w.t0 < t.t_end) AS n_words, '' AS flags
        FROM trimmed t JOIN picked p ON p.tid = t.tid AND p.ord = t.ord""",
    "h3_resnapped_segments": f"""WITH {VIEWS}, usable AS (SELECT * FROM candidates WHERE tid % 31 <> 2), {_FLAGGED}, {starts('usable')}, {ENDS}, {padding('snapped')}, longs AS ({_LONG.format('usable')}), {trimming('longs')}
        SELECT tid, ord, t_start, t_end FROM trimmed UNION ALL SELECT tid, ord, t_start, t_end FROM candidates WHERE tid % 31 = 2""",
    "h3_resnap": f"""WITH {VIEWS}, usable AS (SELECT * FROM candidates WHERE tid % 31 <> 2), {_FLAGGED}, {starts('usable')}, {ENDS}, {padding('snapped')}, longs AS ({_LONG.format('usable')}), {trimming('longs')},
        moved AS (SELECT t.tid, count(*) FILTER (WHERE printf('%.3f', t.t_start) <> printf('%.3f', c.t_start) OR printf('%.3f', t.t_end) <> printf('%.3f', c.t_end)) AS changed
            FROM trimmed t JOIN candidates c ON c.tid = t.tid AND c.ord = t.ord GROUP BY t.tid)
        SELECT DISTINCT c.tid, CASE WHEN c.tid % 31 = 2 THEN 'skipped' ELSE 'resnapped' END AS status, coalesce(changed, 0) AS changed FROM candidates c LEFT JOIN moved m ON m.tid = c.tid""",
}

_MEDIA = """
    media AS (SELECT tid, arg_max(t1, idx) AS duration, CAST(round_even(arg_max(t1, idx) * 8000, 0) AS BIGINT) AS size_bytes FROM words GROUP BY tid),
    gaps AS (SELECT tid, idx, t1 AS s, lead(t0) OVER (PARTITION BY tid ORDER BY idx) AS e FROM words),
    silences AS (SELECT tid, CAST(row_number() OVER (PARTITION BY tid ORDER BY idx) - 1 AS INTEGER) AS pos, s, e FROM gaps WHERE round_even((e - s) * 1000, 0) >= 300)"""
_CHUNKS = """
    placed_ AS (SELECT c.*, n FROM clocked c, unnest(range(greatest(0, ms - 10000) // 120000, ms // 120000 + 1)) AS t(n)),
    cut_ AS (SELECT tid, CAST(n AS INTEGER) AS chunk_no, i, word, (ms - n * 120000) / 1000::DOUBLE AS r0, (ms + len_ms - n * 120000) / 1000::DOUBLE AS r1 FROM placed_ WHERE ms < (n + 1) * 120000 + 10000),
    chunked AS (
        SELECT tid, chunk_no, chunk_no * 120::DOUBLE AS start, CASE WHEN tid % 19 = 4 AND chunk_no = 1 THEN NULL ELSE list({'word': word, 't0': r0 + chunk_no * 120::DOUBLE, 't1': r1 + chunk_no * 120::DOUBLE} ORDER BY i) END AS w
        FROM cut_ GROUP BY tid, chunk_no),
    live AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY chunk_no) AS k FROM chunked WHERE w IS NOT NULL),
    stitched AS (
        SELECT tid, k, w AS kept, w[len(w)].t1 AS last FROM live WHERE k = 1
        UNION ALL
        SELECT s.tid, l.k, list_filter(l.w, lambda x, j: j >= f), coalesce(CASE WHEN f <= len(l.w) THEN l.w[len(l.w)].t1 END, last)
        FROM stitched s JOIN live l ON l.tid = s.tid AND l.k = s.k + 1,
             LATERAL (SELECT coalesce(list_min(list_filter(range(1, len(l.w) + 1), lambda j: l.w[j].t0 >= last)), len(l.w) + 1) AS f) y),
    joined_ AS (SELECT tid, k, unnest(kept) AS x, unnest(range(len(kept))) AS j FROM stitched WHERE len(kept) > 0)"""
_PACK = """
    lined AS (SELECT tid, sent_no AS k, '[' || printf('%06.1f', t0) || '-' || printf('%06.1f', t1) || '] ' || text AS line FROM sentences),
    tok AS (SELECT *, greatest(1, length(line) // 4) AS tokens, count(*) OVER (PARTITION BY tid) AS n, sum(length(line) + 1) OVER (PARTITION BY tid) - 1 AS chars FROM lined),
    pre AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY tid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM tok),
    lists AS (SELECT tid, any_value(n) AS n, any_value(greatest(1, chars // 4)) AS whole, list(p ORDER BY k) AS ps, list_append(list(p ORDER BY k), sum(tokens)) AS pe, list(line ORDER BY k) AS ls FROM pre GROUP BY tid),
    packs AS (
        SELECT tid, 0 AS chunk_no, CAST(0 AS BIGINT) AS a, CASE WHEN whole <= 500 THEN n ELSE greatest(1, list_max(list_filter(range(1, n + 1), lambda j: pe[j + 1] <= 500))) END AS b FROM lists
        UNION ALL
        SELECT q.tid, chunk_no + 1, x.a2, greatest(x.a2 + 1, coalesce(list_max(list_filter(range(x.a2 + 1, n + 1), lambda j: pe[j + 1] - pe[x.a2 + 1] <= 500)), 0))
        FROM packs q JOIN lists l ON l.tid = q.tid, LATERAL (SELECT greatest(q.a + 1, coalesce(list_min(list_filter(range(q.a, q.b + 1), lambda j: pe[q.b + 1] - pe[j + 1] <= 60)), 0)) AS a2) x WHERE q.b < n)"""


def captions(source: str, by: str) -> str:
    """source: words with `by` columns and idx. Leaves capt: by, cap_no, t0, t1, text."""
    keys = ", ".join(f"g.{c} = r.{c}" for c in by.split(", ")).replace(", ", " AND ")
    return f"""
    rows_ AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY idx) AS k FROM {source}),
    runs_ AS (
        SELECT *, lead(word, 1) OVER w AS w2, lead(word, 2) OVER w AS w3, lead(t0, 1) OVER w - t1 > 0.4::DOUBLE AS g2, lead(t0, 2) OVER w - lead(t1, 1) OVER w > 0.4::DOUBLE AS g3
        FROM rows_ WINDOW w AS (PARTITION BY {by} ORDER BY k)),
    sized_ AS (SELECT *, CASE WHEN w2 IS NULL OR g2 OR length(word || ' ' || w2) * 72::DOUBLE * 0.55::DOUBLE > 1000 THEN 1
                              WHEN w3 IS NULL OR g3 OR length(word || ' ' || w2 || ' ' || w3) * 72::DOUBLE * 0.55::DOUBLE > 1000 THEN 2 ELSE 3 END AS size_ FROM runs_),
    groups_ AS (
        SELECT {by}, k, size_, 0 AS cap_no FROM sized_ WHERE k = 1
        UNION ALL
        SELECT {', '.join('r.' + c for c in by.split(', '))}, r.k, r.size_, cap_no + 1 FROM groups_ g JOIN sized_ r ON {keys} AND r.k = g.k + g.size_),
    capt AS (
        SELECT {', '.join('g.' + c for c in by.split(', '))}, cap_no, arg_min(r.t0, r.k) AS t0, arg_max(r.t1, r.k) AS t1, string_agg(r.word, ' ' ORDER BY r.k) AS text
        FROM groups_ g JOIN rows_ r ON {keys} AND r.k >= g.k AND r.k < g.k + g.size_ GROUP BY {', '.join('g.' + c for c in by.split(', '))}, cap_no)"""


def centi(expression: str) -> str:
    cs = f"CAST(round_even(greatest(0::DOUBLE, {expression}) * 100, 0) AS BIGINT)"
    return f"printf('%d:%02d:%02d.%02d', {cs} // 360000, {cs} // 6000 % 60, {cs} // 100 % 60, {cs} % 100)"


SQL |= {
    "a6_parse_silence_log": f"""WITH {VIEWS}, {_MEDIA}, l AS (SELECT *, max(pos) OVER (PARTITION BY tid) AS m FROM silences) SELECT tid, pos, s, e FROM l WHERE NOT (tid % 7 = 0 AND pos = m)""",
    "b6_needs_chunking": f"WITH {VIEWS}, {_MEDIA} SELECT * FROM media WHERE duration > 900 OR size_bytes > 20971520",
    "c2_nearest_split": f"""WITH {VIEWS}, {_MEDIA}, targets AS (SELECT tid, CAST(n AS INTEGER) AS n, n * 600::DOUBLE AS target FROM media, unnest(range(1, greatest(1, CAST(ceil(duration / 600) AS BIGINT)))) AS t(n))
        SELECT t.tid, n, target, coalesce(arg_min((s + e) / 2::DOUBLE, (abs((s + e) / 2::DOUBLE - target), pos)) FILTER (WHERE pos IS NOT NULL), target) AS at
        FROM targets t LEFT JOIN silences x ON x.tid = t.tid AND (s + e) / 2::DOUBLE BETWEEN target - 30 AND target + 30 GROUP BY t.tid, n, target""",
    "e8_stitch_chunks": f"""WITH RECURSIVE {VIEWS}, {_CHUNKS}
        SELECT tid, CASE WHEN tid % 3 = 0 THEN 'en' ELSE 'ru' END AS language, CAST(row_number() OVER (PARTITION BY tid ORDER BY k, j) - 1 AS INTEGER) AS idx, x.word AS word, x.t0 AS t0, x.t1 AS t1 FROM joined_""",
    "d10_coverage_gaps": f"""WITH {VIEWS}, {_CHUNKS.split('live AS')[0].rstrip().rstrip(',')}, n AS (SELECT *, lead(start) OVER (PARTITION BY tid ORDER BY chunk_no) AS nx FROM chunked)
        SELECT tid, chunk_no, start AS lost_from, coalesce(nx, start + 600) AS lost_to FROM n WHERE w IS NULL""",
    "e5_split_oversize": f"""WITH RECURSIVE {VIEWS}, {SENTENCES},
        whole AS (SELECT tid, sent_no, list({{'t0': t0, 't1': t1}} ORDER BY idx) AS a FROM numbered GROUP BY tid, sent_no),
        parts AS (
            SELECT tid, sent_no, a, 0 AS f FROM whole
            UNION ALL
            SELECT tid, sent_no, a[p.x:p.y], f + p.x - 1 FROM parts, LATERAL (
                SELECT list_max(list_transform(range(2, len(a) + 1), lambda k: a[k].t0 - a[k - 1].t1)) AS g) m, LATERAL (
                SELECT list_sort(list_transform(list_filter(range(2, len(a) + 1), lambda k: abs(a[k].t0 - a[k - 1].t1 - g) <= 1e-9::DOUBLE), lambda k: {{'d': abs((k - 1) - len(a) / 2::DOUBLE), 'k': k}}))[1].k AS c) b, LATERAL (
                SELECT unnest([1, c]) AS x, unnest([c - 1, len(a)]) AS y) p
            WHERE len(a) > 1 AND a[len(a)].t1 - a[1].t0 > 4::DOUBLE)
        SELECT tid, CAST(row_number() OVER (PARTITION BY tid ORDER BY sent_no, f) - 1 AS INTEGER) AS sent_no, a[1].t0 AS t0, a[len(a)].t1 AS t1, CAST(len(a) AS INTEGER) AS n_words
        FROM parts WHERE NOT (len(a) > 1 AND a[len(a)].t1 - a[1].t0 > 4::DOUBLE)""",
    "e6_pack_chunks": f"""WITH RECURSIVE {VIEWS}, {SENTENCES}, {_PACK}
        SELECT p.tid, chunk_no, CAST(a AS INTEGER) AS line_from, CAST(b AS INTEGER) AS line_to, md5(array_to_string(ls[a + 1:b], chr(10))) AS text_md5 FROM packs p JOIN lists l ON l.tid = p.tid""",
    "b8_build_requests": f"""WITH RECURSIVE {VIEWS}, {SENTENCES}, {_PACK}
        SELECT p.tid, chunk_no, CAST(4 AS BIGINT) AS n, 'Score 65 or more, 15 to 59 seconds.' AS system, md5(array_to_string(ls[a + 1:b], chr(10))) AS text_md5 FROM packs p JOIN lists l ON l.tid = p.tid""",
    "e7_group_captions": f"WITH RECURSIVE {VIEWS}, {captions('words', 'tid')} SELECT tid, cap_no, t0, t1, text FROM capt",
    "d5_caption_track": f"""WITH RECURSIVE {VIEWS}, held_ AS (SELECT c.tid, c.ord, c.t_start, w.idx, w.word, w.t0, w.t1 FROM candidates c JOIN words w ON w.tid = c.tid AND w.t0 >= c.t_start AND w.t0 < c.t_end),
        {captions('held_', 'tid, ord, t_start')},
        fades AS (SELECT *, (t1 - t0) * 1000 * 0.4::DOUBLE AS budget FROM capt),
        lines_ AS (
            SELECT tid, ord, cap_no, 'Dialogue: 0,' || {centi('t0 - t_start')} || ',' || {centi('t1 - t_start')} || ',Default,,0,0,0,,' ||
                   CASE WHEN 250 > budget AND round_even(150::DOUBLE * (budget / 250::DOUBLE), 0) = 0 AND round_even(100::DOUBLE * (budget / 250::DOUBLE), 0) = 0 THEN ''
                        ELSE '{{\\fad(' || CAST(CASE WHEN 250 > budget THEN round_even(150::DOUBLE * (budget / 250::DOUBLE), 0) ELSE 150 END AS INTEGER) || ',' ||
                             CAST(CASE WHEN 250 > budget THEN round_even(100::DOUBLE * (budget / 250::DOUBLE), 0) ELSE 100 END AS INTEGER) || ')}}' END || upper(replace(text, 'ß', 'SS')) AS line FROM fades)
        SELECT c.tid, c.ord, coalesce(string_agg(line, chr(10) ORDER BY cap_no) || chr(10), '') AS text FROM candidates c LEFT JOIN lines_ l ON l.tid = c.tid AND l.ord = c.ord GROUP BY c.tid, c.ord""",
}

_SOURCES = """
    sources AS (SELECT min(doc_id) AS d, sha256(text) AS sha FROM documents WHERE text IS NOT NULL GROUP BY text),
    files AS (SELECT doc_id AS d, 'v' || doc_id || '.mp4' AS name, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL),
    cal AS (
        SELECT d, sha, CASE WHEN d % 37 = 5 THEN 'corrupt' WHEN d % 7 = 0 THEN 'auto' ELSE 'manual' END AS kind, CAST(CASE WHEN d % 23 = 0 THEN 3000 ELSE 37 * d % 2600 END AS INTEGER) AS x,
               CASE WHEN d % 5 = 0 THEN 1.5::DOUBLE END AS rotation_deg, CASE WHEN d % 4 = 0 THEN 'warm' END AS palette, 'v' || d || '.mp4' AS source_name
        FROM sources WHERE d % 11 <> 0),
    man AS (
        SELECT d, sha, 'v' || d || '.mp4' AS source, CAST((CASE WHEN d % 23 = 0 THEN 3000 ELSE 37 * d % 2600 END) + CASE WHEN d % 7 = 1 THEN 10 ELSE 0 END AS INTEGER) AS x,
               substr(sha256(sha || ':shorts'), 1, 16) AS run_key, CASE WHEN d % 31 = 2 THEN 'unknown_key' WHEN d % 37 = 3 THEN 'invalid_json' WHEN d % 41 = 4 THEN 'out_of_range' END AS reason FROM sources),
    good AS (SELECT * FROM man WHERE reason IS NULL)"""
_REELS = """
    picked AS (SELECT c.*, row_number() OVER (PARTITION BY c.tid ORDER BY ord) AS n FROM candidates c JOIN sources s ON s.d = c.tid WHERE score >= 65),
    reels AS (SELECT tid, count(*) AS n_reels, sum(score) AS scores, string_agg('r' || lpad(CAST(n AS VARCHAR), 5, '0') || ':' || score, ',' ORDER BY n) AS ids FROM picked GROUP BY tid)"""
_STALE = "SELECT m.d, m.source, m.sha AS source_sha256, 'stale' AS state FROM good m JOIN cal c ON c.sha = m.sha AND c.kind <> 'corrupt' WHERE m.x <> c.x"
_EXPORTS = [("text", SQL["d2_paragraph_text"]), ("srt", SQL["d3_cue_track_srt"]), ("vtt", SQL["d3_cue_track_vtt"]), ("json", SQL["d4_word_json"])]
SQL |= {
    "a1_read_word_json": f"WITH {VIEWS} SELECT CAST(tid AS VARCHAR) AS tid, 'en' AS language, idx, word, t0, t1 FROM words",
    "a2_read_segmented_word_json": f"WITH {VIEWS} SELECT CAST(tid AS VARCHAR) AS tid, '' AS language, idx, word, t0, t1 FROM words",
    "a3_read_transcripts": f"WITH {VIEWS} SELECT md5(CAST(tid AS VARCHAR)) AS tid, 'en' AS language, idx, word, t0, t1 FROM words",
    "a3_transcript_files": f"""WITH {VIEWS} SELECT printf('запись %06d+a%%20b', tid) AS tid, count(*) AS n_words, CAST(max(idx) AS INTEGER) AS last_idx FROM words WHERE tid % 7 <> 2 AND tid % 11 <> 3 AND tid % 13 <> 4 GROUP BY tid""",
    "a3_quarantined": f"""WITH {VIEWS} SELECT DISTINCT printf('запись %06d+a%%20b', tid) AS key, CASE WHEN tid % 7 = 2 THEN 'invalid_json' WHEN tid % 11 = 3 THEN 'bad_words' ELSE 'invalid_json' END AS reason
        FROM words WHERE tid % 7 = 2 OR tid % 11 = 3 OR tid % 13 = 4""",
    "a1_quarantined": f"""WITH {VIEWS} SELECT CASE WHEN tid % 7 = 2 THEN 'invalid_json' WHEN tid % 11 = 3 THEN 'bad_words' ELSE 'invalid_json' END AS reason, count(DISTINCT tid) AS n
        FROM words WHERE tid % 7 = 2 OR tid % 11 = 3 OR tid % 13 = 4 GROUP BY 1""",
    "a4_read_manifests": f"""WITH {VIEWS}, {_SOURCES}, {_REELS} SELECT 'v' || d AS key, source, sha AS source_sha256, run_key, 'pending' AS status, x, CASE WHEN d % 5 = 0 THEN 1.5::DOUBLE ELSE 0::DOUBLE END AS rotation, coalesce(n_reels, 0) AS n_reels
        FROM good LEFT JOIN reels ON tid = d""",
    "a4_quarantined": f"WITH {_SOURCES} SELECT 'v' || d AS key, reason FROM man WHERE reason IS NOT NULL",
    "a5_read_calibrations": f"""WITH {_SOURCES} SELECT sha AS source_sha256, kind, CASE WHEN kind <> 'corrupt' THEN source_name END AS source_name, CASE WHEN kind <> 'corrupt' THEN x END AS x,
        CASE WHEN kind <> 'corrupt' THEN rotation_deg END AS rotation_deg, CASE WHEN kind <> 'corrupt' THEN palette END AS palette FROM cal""",
    "a7_write_manifests": f"WITH {VIEWS}, {_SOURCES}, {_REELS} SELECT source, run_key, coalesce(n_reels, 0) AS n_reels, CAST(coalesce(scores, 0) AS BIGINT) AS scores FROM man LEFT JOIN reels ON tid = d",
    "a7_manifest_files": f"WITH {VIEWS}, {_SOURCES}, {_REELS} SELECT lpad(CAST(d AS VARCHAR), 9, '0') || ' 100%25+é.vv' || d AS key, run_key, coalesce(n_reels, 0) AS n_reels FROM man LEFT JOIN reels ON tid = d",
    "a8_write_transcript_export": " UNION ALL ".join(f"SELECT '{fmt}' AS fmt, tid, md5(text) AS text_md5 FROM ({sql})" for fmt, sql in _EXPORTS),
    "a9_write_publication_text": f"WITH {VIEWS}, {_SOURCES}, {_REELS} SELECT tid || '/r' || lpad(CAST(n AS VARCHAR), 5, '0') AS name, title || chr(10) || chr(10) || description || chr(10) AS body FROM picked",
    "b9_run_key": f"WITH {_SOURCES} SELECT name, substr(sha256(sha256 || ':shorts'), 1, 16) AS run_key FROM files",
    "b10_calibration_rules": f"WITH {_SOURCES} SELECT sha AS source_sha256, 'outside_frame' AS rule, true AS hard FROM cal WHERE kind <> 'corrupt' AND x + 1215 > 3840",
    "b10_every_rule": """WITH c AS (
            SELECT 's' || doc_id AS source_sha256, doc_id % 11 * 100 - 100 AS x, [1215, 2160, 3700, 500, 2250][doc_id % 5 + 1] AS w, CASE WHEN doc_id % 2 = 0 THEN 2160 ELSE 3800 END AS h,
                   CASE WHEN doc_id % 3 = 0 THEN 2160 ELSE 3840 END AS fw, CASE WHEN doc_id % 3 = 0 THEN 3840 ELSE 2160 END AS fh FROM documents)
        SELECT source_sha256, 'outside_frame' AS rule, true AS hard FROM c WHERE x < 0 OR x + w > fw OR h > fh
        UNION ALL SELECT source_sha256, 'not_9_16', true FROM c WHERE abs(CAST(w AS DOUBLE) / h - 0.5625::DOUBLE) > 0.02::DOUBLE
        UNION ALL SELECT source_sha256, 'wider_than_frame', false FROM c WHERE fh > fw AND w > fw
        UNION ALL SELECT source_sha256, 'nearly_whole_height', false FROM c WHERE fh > fw AND h >= 0.97::DOUBLE * fh
        UNION ALL SELECT source_sha256, 'nearly_whole_width', false FROM c WHERE fw > fh AND w >= 0.9::DOUBLE * fw
        UNION ALL SELECT source_sha256, 'narrow', false FROM c WHERE w < 0.3::DOUBLE * fw""",
    "c9_both_states": """SELECT 'v' || doc_id AS source, 's' || doc_id AS source_sha256, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 < 3 THEN 'manual_appeared' ELSE 'stale' END AS state
        FROM documents WHERE doc_id % 17 <> 0 AND (doc_id % 3 = 0 OR doc_id % 7 = 0 OR doc_id % 13 = 0)""",
    "b11_estimate_output_size": f"""WITH {VIEWS}, p(profile, bps) AS (VALUES ('hevc', 5128000), ('h264', 7128000), ('tiny', 64900)), ms AS (SELECT tid, sum(CAST(round_even((t_end - t_start) * 1000, 0) AS BIGINT)) AS ms FROM candidates GROUP BY tid)
        SELECT tid, profile, round_even(bps * (ms / 1000::DOUBLE) / 8 / 1048576, 6) AS mb FROM ms, p""",
    "c9_calibration_desync": f"WITH {_SOURCES} SELECT source, source_sha256, state FROM ({_STALE})",
    "c10_recrop": f"""WITH {_SOURCES}, j AS (SELECT m.*, c.kind, c.x AS cx, c.sha AS found FROM good m LEFT JOIN cal c ON c.sha = m.sha AND c.kind <> 'corrupt'),
        k AS (SELECT *, CASE WHEN found IS NOT NULL THEN (CASE WHEN cx + 1215 > 3840 THEN 'skipped' WHEN cx = x THEN 'synced' ELSE 'updated' END) WHEN d % 3 <> 0 THEN 'updated' ELSE 'skipped' END AS recrop FROM j)
        SELECT source, recrop, CAST(CASE WHEN recrop <> 'updated' THEN x WHEN found IS NOT NULL THEN cx ELSE 656 END AS INTEGER) AS x, CAST(CASE WHEN recrop = 'updated' AND found IS NULL THEN 608 ELSE 1215 END AS INTEGER) AS w FROM k""",
    "c11_missing_outputs": f"WITH {VIEWS}, {_SOURCES}, {_REELS} SELECT source, 'r' || lpad(CAST(n AS VARCHAR), 5, '0') AS id FROM good JOIN picked ON tid = d WHERE n % 5 = 0",
    "c12_orphan_manifests": f"WITH {_SOURCES} SELECT source FROM good WHERE NOT (d % 3 = 1 OR (d % 3 = 0 AND d % 2 = 0))",
    "c13_resolve_source": f"""WITH {_SOURCES} SELECT source, sha AS source_sha256, arg_min(name, (CASE WHEN name = source THEN 0 ELSE 1 END, name)) AS name
        FROM good g LEFT JOIN files f ON f.sha256 = g.sha AND f.d % 9 <> 4 GROUP BY source, sha""",
    "c14_rekey_calibrations": f"WITH {_SOURCES} SELECT source_name, sha AS old_sha256, sha256(sha || 'x') AS source_sha256 FROM cal WHERE kind = 'manual' AND d % 6 = 1",
    "c15_renamed_content_guard": f"""WITH {_SOURCES}, r AS (SELECT name, CASE WHEN d % 6 = 1 THEN sha256(sha256 || 'x') ELSE sha256 END AS sha256 FROM files)
        SELECT name, sha256 FROM r WHERE sha256 NOT IN (SELECT sha FROM cal) AND name IN (SELECT source_name FROM cal WHERE kind = 'manual')""",
    "c16_sync_status": f"""WITH {_SOURCES}, s AS ({_STALE})
        SELECT name, coalesce(kind, 'none') AS calibration, CASE WHEN m.reason IS NOT NULL THEN 'corrupt' WHEN m.d IS NULL THEN 'none' WHEN s.d IS NOT NULL THEN 'stale' ELSE 'ok' END AS manifest
        FROM files f LEFT JOIN cal c ON c.sha = f.sha256 LEFT JOIN man m ON m.d = f.d LEFT JOIN s ON s.d = f.d""",
    "d6_assemble_manifest": f"WITH {VIEWS}, {_SOURCES}, {_REELS} SELECT source, sha AS source_sha256, run_key, 'pending' AS status, coalesce(ids, '') AS reels FROM man LEFT JOIN reels ON tid = d",
    "d8_project_status": f"""WITH {VIEWS}, {_SOURCES}, {_REELS} SELECT 'inputs' AS what, count(*) AS n FROM files WHERE d % 3 <> 0 UNION ALL SELECT 'manifests', count(*) FROM good
        UNION ALL SELECT 'rendered', count(*) FROM good JOIN reels ON tid = d UNION ALL SELECT 'archive', count(*) FROM files WHERE d % 3 = 0""",
    "d9_batch_outcome": f"""WITH {_SOURCES}, l AS (SELECT name, CASE WHEN d % 10 = 3 THEN 'skipped' WHEN d % 17 = 4 THEN 'failed' ELSE 'ok' END AS status FROM files)
        SELECT status, count(*) AS n, md5(string_agg(name, ',' ORDER BY name)) AS names_md5 FROM l GROUP BY status""",
    "f2_content_dedup": f"""WITH {_SOURCES}, a AS (SELECT 'n' || d // 2 AS name, sha256 FROM files WHERE d % 2 = 0)
        SELECT i.name, CASE WHEN a.name IS NULL THEN 'accept' WHEN a.sha256 = i.sha256 THEN 'skip' ELSE 'conflict' END AS action FROM (SELECT 'n' || d // 2 AS name, sha256 FROM files WHERE d % 2 = 1) i LEFT JOIN a ON a.name = i.name""",
    "g1_cached_file_hashes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "g2_file_fingerprints": """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS c, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        p AS (SELECT *, greatest(0, n // 2 - 32) AS m, greatest(0, n - 512) AS l FROM b)
        SELECT doc_id, CAST(n AS BIGINT) AS size, sha256(c[1:512] || CASE WHEN m > 512 THEN c[m + 1:m + 64] ELSE ''::BLOB END || CASE WHEN l > 512 OR l > m + 64 THEN c[l + 1:l + 512] ELSE ''::BLOB END ||
            unhex(list_reduce([substr(lpad(hex(n), 16, '0'), k, 2) for k in [15, 13, 11, 9, 7, 5, 3, 1]], lambda x, y: x || y))) AS fingerprint FROM p""",
    "g2_partial_fingerprint": """WITH b AS (SELECT doc_id, encode(text) AS c, octet_length(encode(text)) AS n FROM documents),
        p AS (SELECT *, greatest(0, n // 2 - 32) AS m, greatest(0, n - 512) AS l FROM b)
        SELECT doc_id, sha256(c[1:512] || CASE WHEN m > 512 THEN c[m + 1:m + 64] ELSE ''::BLOB END || CASE WHEN l > 512 OR l > m + 64 THEN c[l + 1:l + 512] ELSE ''::BLOB END ||
            unhex(list_reduce([substr(lpad(hex(n), 16, '0'), k, 2) for k in [15, 13, 11, 9, 7, 5, 3, 1]], lambda x, y: x || y))) AS fingerprint FROM p""",
    "g1_content_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "s1_drain_folder": """WITH f AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        one AS (SELECT doc_id, CAST(strlen(t) AS BIGINT) AS size, CASE WHEN strlen(t) >= 64 THEN sha256(t) END AS sha256,
                       CASE WHEN strlen(t) < 64 THEN 'skipped' WHEN doc_id = min(doc_id) OVER (PARTITION BY t) THEN 'drained' ELSE 'duplicate' END AS status, CAST(1 AS BIGINT) AS batch FROM f),
        two AS (SELECT doc_id, t || repeat('.', 64) || doc_id AS t FROM f WHERE strlen(t) < 64 AND doc_id % 2 = 0)
        SELECT * FROM one UNION ALL SELECT doc_id, CAST(strlen(t) AS BIGINT), sha256(t), 'drained', CAST(2 AS BIGINT) FROM two""",
    "s1_incremental_drain": "SELECT DISTINCT sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE strlen(text) >= 64",
}
