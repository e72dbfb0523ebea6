"""The same queries as plain SQL for DuckDB, written from the rules and not from the Spark plans."""

from __future__ import annotations

# Common table expressions; each may use those above it.
STEPS = {
    "f": """SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value AS lum FROM events""",
    "fr": """SELECT video_id, frame_idx, CAST((video_id * 7 + frame_idx // 12) % 5 AS INT) AS state, lum,
      CAST(coalesce(abs(lum - lag(lum) OVER (PARTITION BY video_id ORDER BY frame_idx)), 0) AS FLOAT) AS diff FROM f""",
    "r0": """SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, state ORDER BY frame_idx) AS g FROM fr""",
    "runs": """SELECT video_id, state, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame FROM r0 GROUP BY video_id, state, g""",
    "pauses": """SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_frame) - 1 AS INT) AS pause_id, start_frame, end_frame
      FROM runs WHERE state = 1""",
    "speeds": """SELECT video_id, state AS type, start_frame, end_frame FROM runs WHERE state IN (2, 3, 4)""",
    "tot": """SELECT video_id, count(*) AS total FROM fr GROUP BY video_id""",
    "gaps": """SELECT video_id, coalesce(lag(last) OVER (PARTITION BY video_id ORDER BY until), -1) + 1 AS start_frame, until - 1 AS end_frame
      FROM (SELECT video_id, start_frame AS until, end_frame AS last FROM pauses UNION ALL SELECT video_id, total, NULL FROM tot)""",
    "clips": """SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_frame) - 1 AS INT) AS clip_id, start_frame, end_frame,
      start_frame AS keep_in, end_frame AS keep_out FROM gaps WHERE start_frame <= end_frame""",
    "bounds": """SELECT p.*, greatest(0, p.start_frame - 1) AS before_index, least(t.total - 1, p.end_frame + 1) AS after_index,
      abs(b.lum - a.lum) AS boundary_diff FROM pauses p JOIN tot t ON t.video_id = p.video_id
      LEFT JOIN fr b ON b.video_id = p.video_id AND b.frame_idx = greatest(0, p.start_frame - 1)
      LEFT JOIN fr a ON a.video_id = p.video_id AND a.frame_idx = least(t.total - 1, p.end_frame + 1)""",
    "modes": """SELECT *, CASE WHEN boundary_diff < 20 THEN 'all' ELSE 'auto' END AS mode FROM bounds""",
    "a0": """SELECT fr.video_id, p.start_frame, p.end_frame, fr.frame_idx, fr.frame_idx - p.start_frame AS k, p.end_frame - p.start_frame + 1 AS n, fr.diff
      FROM fr JOIN pauses p ON p.video_id = fr.video_id AND fr.frame_idx BETWEEN p.start_frame AND p.end_frame""",
    "act": """SELECT *, (k > 0 AND diff > CAST(100 AS FLOAT))
      OR coalesce(lead(diff) OVER (PARTITION BY video_id, start_frame ORDER BY k) > CAST(100 AS FLOAT), false) AS active FROM a0""",
    "b0": """SELECT *, k - row_number() OVER (PARTITION BY video_id, start_frame, active ORDER BY k) AS g,
      bool_or(active) OVER (PARTITION BY video_id, start_frame) AS any_active FROM act""",
    "b": """SELECT *, min(k) OVER w AS ra, max(k) OVER w AS rb FROM b0 WINDOW w AS (PARTITION BY video_id, start_frame, active, g)""",
    "mask": """SELECT video_id, start_frame, k, frame_idx, CAST(CASE
        WHEN NOT any_active THEN n > 6 AND k >= 3 AND n - 1 - k >= 3
        WHEN active OR rb - ra + 1 <= 3 THEN false
        WHEN ra = 0 THEN rb - k >= 3
        WHEN rb = n - 1 THEN k - ra >= 3
        ELSE k - ra >= 1 AND rb - k >= 2 END AS INT) AS m FROM b""",
    "trims": """SELECT *, CASE WHEN (video_id + clip_id) % 2 = 0 THEN 'in' ELSE 'out' END AS side,
      start_frame + (video_id * 13 + clip_id * 7) % (end_frame - start_frame + 1 + 4) - 2 AS aim FROM clips""",
    "trimmed": """SELECT video_id, clip_id, start_frame, end_frame,
      CASE WHEN side = 'in' THEN greatest(start_frame, least(aim, end_frame + 1))
        WHEN least(end_frame, greatest(aim, start_frame - 1)) < start_frame THEN greatest(least(end_frame, greatest(aim, start_frame - 1)) + 1, start_frame)
        ELSE start_frame END AS keep_in,
      CASE WHEN side = 'out' THEN least(end_frame, greatest(aim, start_frame - 1))
        WHEN greatest(start_frame, least(aim, end_frame + 1)) > end_frame THEN least(greatest(start_frame, least(aim, end_frame + 1)) - 1, end_frame)
        ELSE end_frame END AS keep_out FROM trims""",
    "e1": """SELECT m.video_id, m.frame_idx FROM mask m JOIN modes p ON p.video_id = m.video_id AND p.start_frame = m.start_frame
      WHERE p.mode = 'all' OR (p.mode = 'auto' AND m.m IN (1, 2))""",
    "e2": """SELECT fr.video_id, fr.frame_idx FROM fr JOIN trimmed c ON c.video_id = fr.video_id AND fr.frame_idx BETWEEN c.start_frame AND c.end_frame
      WHERE c.keep_in > c.keep_out OR fr.frame_idx < c.keep_in OR fr.frame_idx > c.keep_out""",
    "base": """SELECT fr.video_id, fr.frame_idx, fr.state, e.frame_idx IS NOT NULL AS deleted FROM fr
      LEFT JOIN (SELECT * FROM e1 UNION SELECT * FROM e2) e ON e.video_id = fr.video_id AND e.frame_idx = fr.frame_idx""",
    "t": """SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, state, deleted ORDER BY frame_idx) AS g FROM base""",
    "c": """SELECT *, row_number() OVER (PARTITION BY video_id, state, deleted, g ORDER BY frame_idx) AS c FROM t""",
    "del": """SELECT video_id, frame_idx, state, deleted OR (state = 2 AND c % 2 <> 1) OR (state = 4 AND c % 3 <> 1) AS deleted FROM c""",
    "k0": """SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM del WHERE NOT deleted""",
    "kept": """SELECT video_id, min(frame_idx) AS start_frame, max(frame_idx) + 1 AS end_excl FROM k0 GROUP BY video_id, g""",
    "man": """SELECT video_id, total + video_id % 3 - 1 AS declared, CAST(1280 + video_id % 5 * 160 AS INT) AS src_w,
      CAST(720 + video_id % 4 * 90 AS INT) AS src_h, video_id % 2 = 0 AS has_audio FROM tot""",
    "cuts": """SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_frame) - 1 AS INT) AS cut_no, start_frame, end_excl,
      sum(end_excl - start_frame) OVER (PARTITION BY video_id) AS frames_kept FROM kept""",
    "emb": """SELECT vec_id // 100 AS video_id, vec_id % 100 AS frame_idx, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS g FROM embeddings""",
    "tpl": """SELECT CASE label WHEN 0 THEN 'pause' WHEN 1 THEN 'speed_1x' WHEN 2 THEN 'speed_2x' ELSE 'speed_0_2x' END AS ctype,
      0 AS template_id, min(vec_id) AS vec_id, arg_min(g, vec_id) AS whole, (arg_min(g, vec_id))[17:48] AS t FROM emb WHERE label BETWEEN 0 AND 3 GROUP BY label""",
    "plc": """SELECT e.video_id, e.frame_idx, t.ctype, p.x, e.g[p.x + 1:p.x + 32] AS q, t.t FROM emb e, tpl t, range(0, 33) p(x)""",
    "corr": """SELECT *, list_sum(q) / 32 AS mq, list_sum(t) / 32 AS mt FROM plc""",
    "cor": """SELECT video_id, frame_idx, ctype, x,
      (list_inner_product(q, t) - 32 * mq * mt) / nullif(sqrt((list_inner_product(q, q) - 32 * mq * mq) * (list_inner_product(t, t) - 32 * mt * mt)), 0) AS r FROM corr""",
    "score": """SELECT video_id, frame_idx, ctype, max(r) AS score FROM cor GROUP BY video_id, frame_idx, ctype""",
    "best": """SELECT video_id, frame_idx, coalesce(max(score) FILTER (WHERE ctype = 'pause'), -1) AS pause,
      coalesce(max(score) FILTER (WHERE ctype = 'speed_1x'), -1) AS speed_1x, coalesce(max(score) FILTER (WHERE ctype = 'speed_2x'), -1) AS speed_2x,
      coalesce(max(score) FILTER (WHERE ctype = 'speed_0_2x'), -1) AS speed_0_2x FROM score GROUP BY video_id, frame_idx""",
}
NAMES = list(STEPS)


def _sql(select: str, *, upto: str, extra: str = "") -> str:
    """`select` after the steps up to one of them, and further ones."""
    steps = NAMES[: NAMES.index(upto) + 1]
    if upto in NAMES[NAMES.index("emb") :]:
        steps = [n for n in steps if NAMES.index(n) >= NAMES.index("emb")]
    body = ",\n".join(f"{n} AS ({STEPS[n]})" for n in steps)
    return f"WITH {body}{',' + extra if extra else ''}\n{select}"


def _segments(split: bool, merge: bool) -> str:
    """Steps of the segment query, ending in `seg` (video_id, seg_no, label, name, ranges)."""
    other = "CASE state WHEN 3 THEN '2x' WHEN 2 THEN '1x' WHEN 4 THEN '0.2x' ELSE 'other' END" if split else "'normal'"
    return f"""
    x AS (SELECT b.video_id, b.frame_idx, p.start_frame AS ps, CASE WHEN state = 1 THEN '{"pause_merged" if merge else "pause"}' ELSE {other} END AS label
      FROM base b LEFT JOIN pauses p ON p.video_id = b.video_id AND b.frame_idx BETWEEN p.start_frame AND p.end_frame WHERE NOT deleted),
    y0 AS (SELECT *, CASE WHEN lag(frame_idx) OVER w = frame_idx - 1 AND lag(label) OVER w = label THEN 0 ELSE 1 END AS brk
      FROM x WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
    y AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY frame_idx) AS frag FROM y0),
    z AS (SELECT video_id, frag, min(label) AS label, min(frame_idx) AS a, max(frame_idx) AS b, min(ps) AS ps FROM y GROUP BY video_id, frag),
    h0 AS (SELECT *, CASE WHEN lag(label) OVER w = label AND (label NOT LIKE 'pause%' OR (label = 'pause_merged' AND lag(ps) OVER w = ps)) THEN 0 ELSE 1 END AS brk
      FROM z WINDOW w AS (PARTITION BY video_id ORDER BY frag)),
    h AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY frag) AS seg_no FROM h0),
    s0 AS (SELECT video_id, CAST(seg_no AS BIGINT) AS seg_no, min(label) AS label, string_agg(a || '-' || b, ',' ORDER BY a) AS ranges FROM h GROUP BY video_id, seg_no),
    seg AS (SELECT video_id, seg_no, label, lpad(CAST(seg_no AS VARCHAR), CAST(length(CAST(count(*) OVER (PARTITION BY video_id) AS VARCHAR)) AS INT), '0') || '_' || label AS name, ranges FROM s0)"""


#: The delete mask with parameters that differ by video, ending in `pdel`.
PARAMS = """
    par AS (SELECT video_id, CASE WHEN video_id % 5 <> 0 THEN CAST(video_id % 4 * 90 AS DOUBLE) ELSE 2.0::DOUBLE END AS mt,
      CASE WHEN video_id % 6 <> 0 THEN CAST(video_id % 50 AS DOUBLE) ELSE 5.0::DOUBLE END AS bt, CASE WHEN video_id % 7 <> 0 THEN 2 + video_id % 9 ELSE 10 END AS f2,
      CASE WHEN video_id % 8 <> 0 THEN video_id % 2 = 0 ELSE true END AS s1, CASE WHEN video_id % 9 <> 0 THEN video_id % 4 < 2 ELSE true END AS s2,
      greatest(2, CAST(trunc(CASE WHEN video_id % 4 <> 0 THEN CAST(10 + video_id % 50 AS DOUBLE) ELSE 30.0::DOUBLE END
        * CASE WHEN video_id % 3 <> 0 THEN CAST(video_id % 20 AS DOUBLE) / 100.0::DOUBLE ELSE 0.1::DOUBLE END) AS INT)) AS sf FROM tot),
    pact AS (SELECT a0.*, sf, (k > 0 AND diff > CAST(mt AS FLOAT))
      OR coalesce(lead(diff) OVER (PARTITION BY a0.video_id, start_frame ORDER BY k) > CAST(mt AS FLOAT), false) AS active FROM a0 JOIN par ON par.video_id = a0.video_id),
    pb0 AS (SELECT *, k - row_number() OVER (PARTITION BY video_id, start_frame, active ORDER BY k) AS g, bool_or(active) OVER (PARTITION BY video_id, start_frame) AS any_active FROM pact),
    pb AS (SELECT *, min(k) OVER w AS ra, max(k) OVER w AS rb FROM pb0 WINDOW w AS (PARTITION BY video_id, start_frame, active, g)),
    pe1 AS (SELECT pb.video_id, pb.frame_idx FROM pb JOIN bounds o ON o.video_id = pb.video_id AND o.start_frame = pb.start_frame JOIN par ON par.video_id = pb.video_id
      WHERE o.boundary_diff < bt OR CASE WHEN NOT any_active THEN n > 2 * pb.sf AND k >= pb.sf AND n - 1 - k >= pb.sf WHEN active OR rb - ra + 1 <= pb.sf THEN false
        WHEN ra = 0 THEN rb - k >= pb.sf WHEN rb = n - 1 THEN k - ra >= pb.sf ELSE k - ra >= pb.sf // 2 AND rb - k >= pb.sf - pb.sf // 2 END),
    pe2 AS (SELECT fr.video_id, fr.frame_idx FROM fr JOIN trimmed c ON c.video_id = fr.video_id AND fr.frame_idx BETWEEN c.start_frame AND c.end_frame
      WHERE c.keep_in > c.keep_out OR fr.frame_idx < c.keep_in OR fr.frame_idx > c.keep_out),
    pbase AS (SELECT fr.video_id, fr.frame_idx, fr.state, e.frame_idx IS NOT NULL AS deleted FROM fr
      LEFT JOIN (SELECT * FROM pe1 UNION SELECT * FROM pe2) e ON e.video_id = fr.video_id AND e.frame_idx = fr.frame_idx),
    pt AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, state, deleted ORDER BY frame_idx) AS g FROM pbase),
    pc AS (SELECT *, row_number() OVER (PARTITION BY video_id, state, deleted, g ORDER BY frame_idx) AS c FROM pt),
    pdel AS (SELECT pc.video_id, frame_idx, state, deleted OR (state = 2 AND s1 AND c % 2 <> 1) OR (state = 4 AND s2 AND c % f2 <> 1) AS deleted
      FROM pc JOIN par ON par.video_id = pc.video_id)"""


SCRIPT = """
SELECT c.video_id, string_agg('[0:v]trim=start_frame=' || start_frame || ':end_frame=' || end_excl || ',setpts=PTS-STARTPTS[v' || cut_no || ']'
  || CASE WHEN {audio} THEN ';' || chr(10) || '[0:a]atrim=start=' || printf('%.9f', start_frame / 25.0::DOUBLE) || ':end=' || printf('%.9f', end_excl / 25.0::DOUBLE)
  || ',asetpts=PTS-STARTPTS[a' || cut_no || ']' ELSE '' END, ';' || chr(10) ORDER BY cut_no) || ';' || chr(10)
  || string_agg('[v' || cut_no || ']' || CASE WHEN {audio} THEN '[a' || cut_no || ']' ELSE '' END, '' ORDER BY cut_no) || 'concat=n=' || count(*)
  || CASE WHEN bool_or({audio}) THEN ':v=1:a=1[outv][outa]' ELSE ':v=1:a=0[outv]' END AS script
FROM cuts c JOIN man ON man.video_id = c.video_id GROUP BY c.video_id
"""


def oracle_sql() -> dict[str, str]:
    rec = "CAST(start_frame AS VARCHAR) || ':' || end_frame || ':' || before_index || ':' || after_index"
    same = """
      SELECT t.video_id, count(p.pause_id) AS n,
        bool_or(t.video_id % 11 IN (3, 5) AND p.pause_id IS NOT NULL) AS changed FROM tot t LEFT JOIN pauses p ON p.video_id = t.video_id GROUP BY t.video_id"""
    usable = "q NOT IN (1, 7, 8, 9) AND NOT (q IN (3, 5, 10) AND n > 0)"
    context = _sql(
        f"""SELECT t.video_id, 1 AS version, true AS complete, total AS frame_count, total AS decoded_frame_count,
          coalesce(string_agg({rec}, ',' ORDER BY start_frame), '') AS records, round(coalesce(sum(boundary_diff), 0), 4) AS diff_sum
        FROM tot t LEFT JOIN bounds b ON b.video_id = t.video_id GROUP BY t.video_id, total""",
        upto="bounds",
    )
    return {
        "state_runs": _sql("SELECT * FROM runs", upto="runs"),
        "state_runs_blocked": _sql("SELECT * FROM runs", upto="runs"),
        "pause_segments": _sql("SELECT * FROM pauses", upto="pauses"),
        "speed_segments": _sql("SELECT * FROM speeds", upto="speeds"),
        "clip_segments": _sql("SELECT * FROM clips", upto="clips"),
        "frame_diff": _sql("SELECT video_id, frame_idx, CAST(diff AS DOUBLE) AS diff FROM fr", upto="fr"),
        "boundary_modes": _sql("SELECT * FROM modes", upto="modes"),
        "stored_pauses": _sql(
            """SELECT b.video_id, b.pause_id, b.start_frame, b.end_frame, b.boundary_diff, count(*) FILTER (WHERE a.active) AS n_active
            FROM bounds b JOIN act a ON a.video_id = b.video_id AND a.start_frame = b.start_frame
            GROUP BY b.video_id, b.pause_id, b.start_frame, b.end_frame, b.boundary_diff""",
            upto="act",
        ),
        "pause_activity": _sql("SELECT video_id, frame_idx, k, n, active FROM act", upto="act"),
        "pause_mask": _sql("SELECT * FROM mask", upto="mask"),
        "pause_deletes": _sql("SELECT * FROM e1", upto="e1"),
        "clip_deletes": _sql("SELECT * FROM e2", upto="e2"),
        "speedup_deletes": _sql(
            """SELECT video_id, frame_idx, state, state = 4 AND (frame_idx - min(frame_idx) OVER (PARTITION BY video_id, state, g)) % 3 <> 0 AS deleted FROM r0""",
            upto="r0",
        ),
        "delete_mask": _sql("SELECT * FROM del", upto="del"),
        "delete_mask_fused": _sql("SELECT * FROM del", upto="del"),
        "delete_mask_joined": _sql("SELECT * FROM del", upto="del"),
        "delete_mask_params": _sql("SELECT * FROM pdel", upto="trimmed", extra=PARAMS),
        "deletes_from_list": _sql(
            """SELECT video_id, frame_idx, EXISTS (SELECT 1 FROM events e WHERE e.user_id = fr.video_id AND e.event_id % 120 = fr.frame_idx) AS deleted FROM fr""",
            upto="fr",
        ),
        "kept_ranges": _sql("SELECT * FROM kept", upto="kept"),
        "kept_ranges_frames": _sql("SELECT * FROM kept", upto="kept"),
        "skip_ranges": _sql(
            """SELECT video_id, start_frame, end_frame + 1 AS end_excl FROM modes WHERE mode = 'all'
            UNION ALL SELECT video_id, min(frame_idx), max(frame_idx) + 1 FROM (
              SELECT m.*, m.frame_idx - row_number() OVER (PARTITION BY m.video_id, m.start_frame ORDER BY m.frame_idx) AS g
              FROM mask m JOIN modes p ON p.video_id = m.video_id AND p.start_frame = m.start_frame WHERE p.mode = 'auto' AND m.m = 1
            ) GROUP BY video_id, start_frame, g
            UNION ALL SELECT video_id, start_frame, end_frame + 1 FROM trimmed WHERE keep_in > keep_out
            UNION ALL SELECT video_id, start_frame, keep_in FROM trimmed WHERE keep_in <= keep_out AND keep_in > start_frame
            UNION ALL SELECT video_id, keep_out + 1, end_frame + 1 FROM trimmed WHERE keep_in <= keep_out AND keep_out < end_frame""",
            upto="trimmed",
        ),
        "skip_ranges_frames": _sql(
            """SELECT video_id, start_frame, end_frame + 1 AS end_excl FROM modes WHERE mode = 'all'
            UNION ALL SELECT video_id, min(frame_idx), max(frame_idx) + 1 FROM (
              SELECT m.*, m.frame_idx - row_number() OVER (PARTITION BY m.video_id, m.start_frame ORDER BY m.frame_idx) AS g
              FROM mask m JOIN modes p ON p.video_id = m.video_id AND p.start_frame = m.start_frame WHERE p.mode = 'auto' AND m.m = 1
            ) GROUP BY video_id, start_frame, g
            UNION ALL SELECT video_id, start_frame, end_frame + 1 FROM trimmed WHERE keep_in > keep_out
            UNION ALL SELECT video_id, start_frame, keep_in FROM trimmed WHERE keep_in <= keep_out AND keep_in > start_frame
            UNION ALL SELECT video_id, keep_out + 1, end_frame + 1 FROM trimmed WHERE keep_in <= keep_out AND keep_out < end_frame""",
            upto="trimmed",
        ),
        "next_kept": _sql(
            """SELECT b.video_id, b.frame_idx, coalesce((SELECT min(k.frame_idx) FROM base k WHERE k.video_id = b.video_id AND k.frame_idx >= b.frame_idx AND NOT k.deleted), t.total) AS next_frame
            FROM base b JOIN tot t ON t.video_id = b.video_id""",
            upto="base",
        ),
        "next_kept_frames": _sql(
            """SELECT b.video_id, b.frame_idx, coalesce((SELECT min(k.frame_idx) FROM base k WHERE k.video_id = b.video_id AND k.frame_idx >= b.frame_idx AND NOT k.deleted), t.total) AS next_frame
            FROM base b JOIN tot t ON t.video_id = b.video_id""",
            upto="base",
        ),
        "cut_list": _sql(
            "SELECT video_id, cut_no, start_frame, end_excl, start_frame / 30.0::DOUBLE AS start_s, end_excl / 30.0::DOUBLE AS end_s, CAST(frames_kept AS BIGINT) AS frames_kept FROM cuts",
            upto="cuts",
        ),
        "cut_script": _sql(SCRIPT.format(audio="false"), upto="cuts"),
        "cut_script_audio": _sql(SCRIPT.format(audio="has_audio"), upto="cuts"),
        "cut_script_packed": _sql(SCRIPT.format(audio="has_audio"), upto="cuts"),
        "segments": _sql("SELECT * FROM seg", upto="base", extra=_segments(False, True)),
        "segments_frames": _sql("SELECT * FROM seg", upto="base", extra=_segments(False, True)),
        "segments_split": _sql("SELECT * FROM seg", upto="base", extra=_segments(True, True)),
        "segments_unmerged": _sql("SELECT * FROM seg", upto="base", extra=_segments(False, False)),
        "edit_summary": _sql(
            """SELECT d.video_id, count(*) AS total, count(*) FILTER (WHERE NOT deleted) AS kept, count(*) FILTER (WHERE deleted) AS gone,
              count(*) FILTER (WHERE NOT deleted AND state = 0) AS kept_normal, count(*) FILTER (WHERE NOT deleted AND state = 1) AS kept_pause,
              count(*) FILTER (WHERE NOT deleted AND state = 2) AS kept_1x, count(*) FILTER (WHERE NOT deleted AND state = 3) AS kept_2x,
              count(*) FILTER (WHERE NOT deleted AND state = 4) AS kept_0_2x,
              (SELECT count(*) FROM pauses p WHERE p.video_id = d.video_id) AS n_pauses, (SELECT count(*) FROM speeds s WHERE s.video_id = d.video_id) AS n_speeds
            FROM del d GROUP BY d.video_id""",
            upto="del",
        ),
        "edit_summary_frames": _sql(
            """SELECT d.video_id, count(*) AS total, count(*) FILTER (WHERE NOT deleted) AS kept, count(*) FILTER (WHERE deleted) AS gone,
              count(*) FILTER (WHERE NOT deleted AND state = 0) AS kept_normal, count(*) FILTER (WHERE NOT deleted AND state = 1) AS kept_pause,
              count(*) FILTER (WHERE NOT deleted AND state = 2) AS kept_1x, count(*) FILTER (WHERE NOT deleted AND state = 3) AS kept_2x,
              count(*) FILTER (WHERE NOT deleted AND state = 4) AS kept_0_2x,
              (SELECT count(*) FROM pauses p WHERE p.video_id = d.video_id) AS n_pauses, (SELECT count(*) FROM speeds s WHERE s.video_id = d.video_id) AS n_speeds
            FROM del d GROUP BY d.video_id""",
            upto="del",
        ),
        "export_report": _sql(
            """SELECT video_id, count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed,
              coalesce(string_agg(line, chr(10) ORDER BY seg_no) FILTER (WHERE NOT ok AND rn <= 3), '') AS details FROM (
              SELECT *, row_number() OVER (PARTITION BY video_id, ok ORDER BY seg_no) AS rn,
                '- ' || name || ': ' || substr('error ' || repeat('x', CAST((video_id * seg_no) % 600 AS INT)), 1, 500) AS line
              FROM (SELECT *, (video_id + seg_no) % 4 > 0 AND (video_id * 3 + seg_no) % 5 > 0 AS ok FROM seg)
            ) GROUP BY video_id""",
            upto="base",
            extra=_segments(True, True),
        ),
        "frame_info": _sql(
            """SELECT fr.video_id, fr.frame_idx, p.pause_id, p.mode, CASE WHEN p.pause_id IS NOT NULL THEN coalesce(p.boundary_diff, 0) END AS boundary_diff, s.type,
              CASE WHEN p.pause_id IS NOT NULL THEN 'pause' WHEN s.type = 3 THEN '2x' WHEN s.type = 2 THEN '1x' WHEN s.type = 4 THEN '0.2x' ELSE 'normal' END AS kind
            FROM fr LEFT JOIN modes p ON p.video_id = fr.video_id AND fr.frame_idx BETWEEN p.start_frame AND p.end_frame
            LEFT JOIN speeds s ON s.video_id = fr.video_id AND fr.frame_idx BETWEEN s.start_frame AND s.end_frame""",
            upto="modes",
        ),
        "effective_speed": _sql(
            """SELECT video_id, frame_idx,
              CASE WHEN state = 2 AND video_id % 2 = 0 THEN 2 WHEN state = 4 THEN video_id % 4 ELSE 1 END * 1.5::DOUBLE AS speed,
              CAST(CASE WHEN state = 2 AND video_id % 2 = 0 THEN 2 WHEN state = 4 THEN greatest(2, video_id % 4) ELSE 1 END AS INT) AS step FROM fr""",
            upto="fr",
        ),
        "clock_label": _sql(
            """SELECT video_id, frame_idx, lpad(CAST(s // 60 AS VARCHAR), CAST(greatest(2, length(CAST(s // 60 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
            FROM (SELECT *, CAST(floor(frame_idx * 997 / 30.0::DOUBLE) AS BIGINT) AS s FROM fr)""",
            upto="fr",
        ),
        "timeline_bins": _sql(
            """SELECT video_id, bin, CAST(sum(n) AS BIGINT) AS n_frames, CAST(sum(d) AS BIGINT) AS n_deleted, arg_max(state, n * 10 - state) AS state FROM (
              SELECT d.video_id, CAST(floor((frame_idx::DOUBLE / total::DOUBLE - 0.25::DOUBLE) * 2.0::DOUBLE * 40.0::DOUBLE) AS BIGINT) AS bin, state,
                count(*) AS n, count(*) FILTER (WHERE deleted) AS d FROM del d JOIN tot t ON t.video_id = d.video_id GROUP BY 1, 2, 3
            ) WHERE bin BETWEEN 0 AND 39 GROUP BY video_id, bin""",
            upto="del",
        ),
        "timeline_pyramid": _sql(
            """SELECT view, video_id, bin, CAST(sum(n) AS BIGINT) AS n_frames, CAST(sum(d) AS BIGINT) AS n_deleted, arg_max(state, n * 10 - state) AS state FROM (
              SELECT view, w, d.video_id, CAST(floor((frame_idx::DOUBLE / total::DOUBLE - scroll) * zoom * w::DOUBLE) AS BIGINT) AS bin, state,
                count(*) AS n, count(*) FILTER (WHERE deleted) AS d FROM del d JOIN tot t ON t.video_id = d.video_id,
                (VALUES (0, 40, 2.0::DOUBLE, 0.25::DOUBLE), (1, 7, 1.0::DOUBLE, 0.0::DOUBLE), (2, 100, 13.7::DOUBLE, 0.61::DOUBLE)) v(view, w, zoom, scroll) GROUP BY ALL
            ) WHERE bin BETWEEN 0 AND w - 1 GROUP BY view, video_id, bin""",
            upto="del",
        ),
        "audit_frames": _sql(
            """SELECT coalesce(m.video_id, g.video_id) AS video_id, coalesce(declared, 0) AS declared, coalesce(decoded, 0) AS decoded, coalesce(n_bad, 0) AS n_bad, coalesce(holes, 0) AS holes,
              coalesce(repeats, 0) AS repeats, CASE WHEN m.video_id IS NULL THEN 'unlisted' WHEN decoded IS NULL THEN 'empty' WHEN n_bad > 0 THEN 'bad_payload'
              WHEN holes > 0 OR repeats > 0 THEN 'not_dense' WHEN decoded < declared THEN 'short' WHEN decoded > declared THEN 'understated' ELSE 'ok' END AS status
            FROM (SELECT CASE WHEN video_id % 13 = 0 THEN -video_id - 1 ELSE video_id END AS video_id, declared FROM man) m FULL JOIN (
              SELECT video_id, count(*) AS decoded, count(*) FILTER (WHERE video_id % 7 = 0 AND frame_idx = 3) AS n_bad,
                max(frame_idx) + 1 - count(DISTINCT frame_idx) AS holes, count(*) - count(DISTINCT frame_idx) AS repeats
              FROM (SELECT video_id, frame_idx FROM fr WHERE NOT (video_id % 13 = 0 AND frame_idx = 5)
                UNION ALL SELECT video_id, frame_idx FROM fr WHERE video_id % 13 = 0 AND frame_idx = 7) GROUP BY video_id
            ) g ON g.video_id = m.video_id""",
            upto="man",
        ),
        "resolve_params": _sql(
            """SELECT *, greatest(2, CAST(trunc(fps * still_time) AS INT)) AS still_frames FROM (
              SELECT video_id, CASE WHEN video_id % 4 <> 0 AND video_id % 50 > 0 THEN CAST(video_id % 50 AS DOUBLE) ELSE 30.0::DOUBLE END AS fps,
                0.7::DOUBLE AS thr_pause, 0.7::DOUBLE AS thr_1x, 0.7::DOUBLE AS thr_2x, 0.7::DOUBLE AS thr_02x,
                CASE WHEN video_id % 3 <> 0 THEN CAST(video_id % 40 AS DOUBLE) / 100.0::DOUBLE ELSE 0.1::DOUBLE END AS still_time,
                CASE WHEN video_id % 5 <> 0 THEN CAST(video_id % 60 AS DOUBLE) ELSE 2.0::DOUBLE END AS motion_thresh, 5.0::DOUBLE AS boundary_thresh,
                CASE WHEN video_id % 6 <> 0 THEN CAST(video_id % 25 AS INT) ELSE 10 END AS factor_02, 400 AS proc_w, 225 AS proc_h,
                CASE WHEN video_id % 7 <> 0 THEN video_id % 2 = 0 ELSE true END AS speedup_1x, true AS speedup_02, false AS split_by_speed, true AS merge_pause,
                (video_id % 3 = 0 OR video_id % 40 BETWEEN 1 AND 200) AND (video_id % 5 = 0 OR video_id % 60 BETWEEN 1 AND 50)
                  AND (video_id % 6 = 0 OR video_id % 25 BETWEEN 2 AND 20) AS in_range FROM tot)""",
            upto="tot",
        ),
        "template_geometry": _sql(
            """SELECT video_id, greatest(0, CAST(trunc(x * sx - w * sx * 0.5::DOUBLE) AS INT)) AS roi_x, greatest(0, CAST(trunc(y * sy - h * sy * 0.5::DOUBLE) AS INT)) AS roi_y,
              CAST(trunc(w * sx * 2.0::DOUBLE) AS INT) AS roi_w, CAST(trunc(h * sy * 2.0::DOUBLE) AS INT) AS roi_h,
              greatest(1, CAST(trunc(w * sx) AS INT)) AS tw, greatest(1, CAST(trunc(h * sy) AS INT)) AS th FROM (
              SELECT video_id, video_id * 17 % 900 AS x, video_id * 11 % 500 AS y, 1 + video_id * 3 % 160 AS w, 1 + video_id * 5 % 90 AS h,
                400 / 1280.0::DOUBLE AS sx, 225 / 720.0::DOUBLE AS sy FROM tot)""",
            upto="tot",
        ),
        "proc_height": _sql(
            "SELECT video_id, CASE WHEN video_id % 3 = 0 THEN 300 ELSE CAST(floor(400.0::DOUBLE * src_h / src_w) AS INT) END AS proc_h FROM man", upto="man"
        ),
        "usable_templates": _sql("SELECT ctype, template_id, vec_id FROM tpl WHERE ctype <> 'speed_2x'", upto="tpl"),
        "vector_diff": _sql(
            """SELECT video_id, frame_idx, round(CAST(CAST(coalesce((SELECT sum(abs(a - b)) / 64 FROM (SELECT unnest(g) AS a, unnest(prev) AS b)), 0) AS FLOAT) AS DOUBLE), 4) AS diff
            FROM (SELECT *, lag(g) OVER (PARTITION BY video_id ORDER BY frame_idx) AS prev FROM emb)""",
            upto="emb",
        ),
        "template_scores": _sql("SELECT video_id, frame_idx, ctype, round(score, 4) AS score FROM score", upto="score"),
        "template_scores_2d": _sql(
            "SELECT video_id, frame_idx, ctype, round(max(r), 4) AS score FROM c2 GROUP BY video_id, frame_idx, ctype",
            upto="tpl",
            extra="""
            cells AS (SELECT ctype, i, whole[(2 + i // 3) * 8 + 3 + i % 3] AS t FROM tpl, range(0, 9) c(i)),
            pix AS (SELECT e.video_id, e.frame_idx, c.ctype, x, y, c.t, e.g[(y + c.i // 3) * 8 + x + c.i % 3 + 1] AS q
              FROM emb e, cells c, range(1, 5) px(x), range(1, 6) py(y) WHERE c.t > -0.1),
            c2 AS (SELECT video_id, frame_idx, ctype, x, y, (sum(q * t) - sum(q) * sum(t) / count(*))
              / nullif(sqrt((sum(q * q) - sum(q) * sum(q) / count(*)) * (sum(t * t) - sum(t) * sum(t) / count(*))), 0) AS r FROM pix GROUP BY 1, 2, 3, 4, 5)""",
        ),
        "best_scores": _sql(
            "SELECT video_id, frame_idx, round(pause, 4) AS pause, round(speed_1x, 4) AS speed_1x, round(speed_2x, 4) AS speed_2x, round(speed_0_2x, 4) AS speed_0_2x FROM best",
            upto="best",
        ),
        "classify": _sql(
            """SELECT video_id, frame_idx, CASE WHEN pause >= 0.4 THEN 1 WHEN speed_1x >= 0.4 AND speed_1x > speed_2x THEN 2
              WHEN speed_2x >= 0.4 AND speed_2x > speed_1x THEN 3 WHEN speed_0_2x >= 0.4 THEN 4 ELSE 0 END AS state FROM best""",
            upto="best",
        ),
        "classify_short": _sql(
            """SELECT video_id, frame_idx, CASE WHEN pause >= 0.4 THEN 1 WHEN speed_1x >= 0.4 AND speed_1x > speed_2x THEN 2
              WHEN speed_2x >= 0.4 AND speed_2x > speed_1x THEN 3 WHEN speed_0_2x >= 0.4 THEN 4 ELSE 0 END AS state FROM best""",
            upto="best",
        ),
        "locate_templates": _sql(
            """SELECT c.ctype, 0 AS template_id, CAST(arg_max(x, round(r, 12) * 1000 - x * 1e-9) AS INT) AS x, 0 AS y, round(max(r), 4) AS score
            FROM cor c JOIN tpl t ON t.ctype = c.ctype AND c.video_id * 100 + c.frame_idx = t.vec_id GROUP BY c.ctype""",
            upto="cor",
        ),
        "template_mask": _sql("SELECT vec_id, CAST(len(list_filter(g, lambda x: x * 100 > 10)) AS INT) AS n_on FROM emb", upto="emb"),
        "mode_batch": _sql("SELECT *, CASE WHEN coalesce(boundary_diff, 0) < 300 THEN 'all' ELSE 'auto' END AS mode FROM bounds", upto="bounds"),
        "mode_batch_params": _sql("SELECT *, CASE WHEN coalesce(boundary_diff, 0) < video_id % 7 * 100 THEN 'all' ELSE 'auto' END AS mode FROM bounds", upto="bounds"),
        "mode_edits": _sql(
            """SELECT video_id, pause_id, start_frame, end_frame, before_index, after_index, boundary_diff,
              CASE WHEN (video_id + pause_id) % 3 = 0 THEN CASE video_id % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'all' ELSE 'auto' END ELSE mode END AS mode FROM modes""",
            upto="modes",
        ),
        "mask_edits": _sql(
            """SELECT video_id, pause_id, CAST(k AS INT) AS k, CAST(CASE WHEN mode = 'auto' AND blk = max(CASE WHEN k = aim THEN blk END) OVER (PARTITION BY video_id, pause_id)
                THEN CASE WHEN m = 0 THEN 2 ELSE 3 END ELSE m END AS INT) AS m FROM (
              SELECT *, sum(chg) OVER (PARTITION BY video_id, pause_id ORDER BY k) AS blk FROM (
                SELECT m.video_id, p.pause_id, p.mode, m.k, m.m, (m.video_id * 5 + p.pause_id) % (p.end_frame - p.start_frame + 1) AS aim,
                  CASE WHEN lag(m.m) OVER (PARTITION BY m.video_id, p.pause_id ORDER BY m.k) = m.m THEN 0 ELSE 1 END AS chg
                FROM mask m JOIN modes p ON p.video_id = m.video_id AND p.start_frame = m.start_frame))""",
            upto="mask",
        ),
        "mode_mask_edits": _sql(
            """SELECT video_id, pause_id, CASE WHEN (video_id + pause_id) % 3 = 0 THEN CASE video_id % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'all' ELSE 'auto' END ELSE mode END AS mode,
              CAST(k AS INT) AS k, CAST(CASE WHEN (mode = 'auto' OR ((video_id + pause_id) % 3 = 0 AND video_id % 3 = 2)) AND blk = max(CASE WHEN k = aim THEN blk END) OVER (PARTITION BY video_id, pause_id)
                THEN CASE WHEN m = 0 THEN 2 ELSE 3 END ELSE m END AS INT) AS m FROM (
              SELECT *, sum(chg) OVER (PARTITION BY video_id, pause_id ORDER BY k) AS blk FROM (
                SELECT m.video_id, p.pause_id, p.mode, m.k, m.m, (m.video_id * 5 + p.pause_id) % (p.end_frame - p.start_frame + 1) AS aim,
                  CASE WHEN lag(m.m) OVER (PARTITION BY m.video_id, p.pause_id ORDER BY m.k) = m.m THEN 0 ELSE 1 END AS chg
                FROM mask m JOIN modes p ON p.video_id = m.video_id AND p.start_frame = m.start_frame))""",
            upto="mask",
        ),
        "trim_edits": _sql("SELECT * FROM trimmed", upto="trimmed"),
        "validate_context": _sql(
            f"SELECT video_id, {usable} AS usable FROM (SELECT video_id, video_id % 11 AS q, n FROM same)", upto="bounds", extra=f"same AS ({same})"
        ),
        "build_context": context,
        "reuse_boundaries": _sql("SELECT * FROM bounds", upto="bounds"),
        "stream_boundaries": _sql("SELECT video_id, start_frame, end_frame, before_index, after_index, boundary_diff AS diff FROM bounds", upto="bounds"),
        "stream_context": context,
        "number_frames": "SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, event_id FROM events",
    }
