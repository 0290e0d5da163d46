"""The same queries as plain SQL over the given tables, for a side-by-side check."""

SIZE, GRACE, WEEK, HOUR = 21_600_000, 3_600_000, 604_800_000, 3_600_000

# Named building blocks; each one may use those above it.
BLOCKS = {
    "sensor": """
        SELECT event_id, event_type, 'device-' || user_id AS device_id, value AS temperature,
               epoch_us(ts) // 1000 AS event_ms FROM events""",
    "late": """
        SELECT event_id, event_type, device_id, temperature, event_ms AS arrival_ms,
               event_ms - CASE WHEN event_id % 33 = 0 THEN (1 + event_id % 8) * 3600000 ELSE 0 END AS event_ms
        FROM sensor""",
    "latew": f"""
        SELECT *, event_ms - event_ms % {SIZE} AS ws,
               event_ms - event_ms % {SIZE} + {SIZE} + {GRACE} < arrival_ms AS late FROM late""",
    "fed": """
        SELECT latew.*, least(2, (arrival_ms - low) // ((high - low) // 3 + 1) + (event_id % 7 = 0)::INTEGER) AS arrival
        FROM latew CROSS JOIN (SELECT min(arrival_ms) AS low, max(arrival_ms) AS high FROM latew )""",
    "verdicts": f"""
        SELECT fed.*, CASE WHEN late THEN 'late' WHEN ws + {SIZE} <= mark THEN 'dropped' ELSE 'processed' END AS verdict
        FROM fed JOIN (SELECT a.arrival, greatest(0, coalesce(max(b.event_ms) - {GRACE}, 0)) AS mark
                       FROM (SELECT DISTINCT arrival FROM fed) a LEFT JOIN fed b ON b.arrival < a.arrival
                       GROUP BY a.arrival) USING (arrival)""",
    "ship": """
        SELECT 'device-' || l_suppkey AS device_id, l_quantity AS temperature, epoch_us(l_shipdate) // 1000 AS event_ms
        FROM lineitem""",
    "hashed": """
        SELECT *, list_reduce(list_transform(string_split(device_id, ''), lambda x: unicode(x)::BIGINT),
                              lambda a, c: (a * 31 + c) & 2147483647) AS h FROM sensor""",
    "numbered": """
        SELECT (h % 4)::INTEGER AS "partition", device_id AS key,
               '{"deviceId":"' || device_id || '","temperature":' || temperature::VARCHAR
                   || ',"timestamp":' || event_ms || '}' AS value,
               event_type AS producer_id,
               row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq,
               event_ms, event_id FROM hashed""",
    "attempts": """
        SELECT "partition", key, value, producer_id, seq, 0::INTEGER AS attempt, event_ms AS arrival_ms,
               event_id AS tie FROM numbered
        UNION ALL
        SELECT "partition", key, value, producer_id, seq, 1::INTEGER, event_ms + 1000, event_id
        FROM numbered WHERE event_id % 50 = 0""",
    "marked": """
        SELECT *, max(seq) OVER (PARTITION BY "partition", producer_id ORDER BY arrival_ms, attempt, tie
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hw FROM attempts""",
    "kept": "SELECT * FROM marked WHERE hw IS NULL OR seq > hw",
    "wide": """
        SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY arrival_ms, attempt, tie) - 1 AS "offset"
        FROM kept""",
    "log": """
        SELECT "partition", "offset", key, value, arrival_ms AS "timestamp", producer_id, seq FROM wide""",
    "consumed": """SELECT * FROM log WHERE "offset" % 97 <> 0""",
    "replica": """
        SELECT "partition", "offset", key,
               CASE WHEN "offset" % 101 = 0 THEN value || '*' ELSE value END AS value, "timestamp"
        FROM consumed""",
    "diff": """
        SELECT coalesce(a."partition", b."partition") AS "partition",
               coalesce(a."offset", b."offset") AS "offset",
               CASE WHEN a."offset" IS NULL THEN 'missing_left' WHEN b."offset" IS NULL THEN 'missing_right'
                    WHEN a.key IS DISTINCT FROM b.key OR a.value IS DISTINCT FROM b.value
                         OR a."timestamp" IS DISTINCT FROM b."timestamp" THEN 'differs' ELSE 'same' END AS status
        FROM log a FULL JOIN replica b ON a."partition" = b."partition" AND a."offset" = b."offset" """,
    "damaged": """SELECT * FROM consumed UNION ALL SELECT * FROM log WHERE "offset" % 89 = 0""",
    "lat": """
        SELECT event_type, user_id, event_type <> 'error' AS success,
               (round(value * 100)::BIGINT * 10000000) // 1000000 AS ms FROM events""",
}


def _with(body: str, *names: str) -> str:
    """The body behind the blocks it names and every block before them."""
    order = list(BLOCKS)
    used, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in used:
            used.add(name)
            text = BLOCKS[name].replace("\n", " ") + " "
            todo += [n for n in order if f"FROM {n} " in text or f"JOIN {n} " in text]
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in order if n in used) + "\n" + body


def _agg(source: str, size: int, where="TRUE", names=()) -> str:
    return _with(f"""
        SELECT device_id, event_ms - event_ms % {size} AS window_start_ms,
               event_ms - event_ms % {size} + {size} AS window_end_ms, count(*) AS count,
               round(sum(temperature), 2) AS sum, round(sum(temperature), 2) / count(*) AS avg,
               max(temperature) AS max
        FROM {source} WHERE {where} GROUP BY 1, 2, 3""", *(names or (source,)))


_DONE = f"event_ms - event_ms % {SIZE} + {SIZE} + {GRACE} <= (SELECT max(event_ms) FROM sensor)"

# The text a double has in its shortest form, rounded half up to one decimal.
_ONE_DP = "printf('%.1f', round(cast(cast({0} AS VARCHAR) AS DECIMAL(38, 17)), 1)::DOUBLE)"


def _ranks(where: str) -> str:
    pick = "coalesce(min(CASE WHEN rn = greatest(1, ceil({p} / 100.0 * n)) THEN ms END), 0) AS p{p}"
    return ", ".join(pick.format(p=p) for p in (50, 95, 99))


def _ordered(by: str, where="TRUE") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return (f"(SELECT *, row_number() OVER ({part}ORDER BY ms) AS rn, count(*) OVER ({part}) AS n "
            f"FROM lat WHERE {where})")


_ATTEMPT = '"partition", key, value, producer_id, seq, attempt, arrival_ms, tie'
_LOG = '"partition", "offset", key, value, "timestamp", producer_id, seq'
_LATE = "event_id, device_id, temperature, event_ms, arrival_ms"
_UTF16 = """
    SELECT doc_id, list_reduce(list_prepend(0::BIGINT, flatten(list_transform(string_split(text, ''),
               lambda x: CASE WHEN unicode(x) < 65536 THEN [unicode(x)::BIGINT]
                   ELSE [55296 + (unicode(x)::BIGINT - 65536) // 1024, 56320 + (unicode(x)::BIGINT - 65536) % 1024] END))),
               lambda a, c: (a * 31 + c) & 2147483647) AS key_hash
    FROM documents"""


_ACKS = _with(f"""
    SELECT {_ATTEMPT}, "offset" IS NOT NULL AS accepted,
           last_value("offset" IGNORE NULLS) OVER (PARTITION BY "partition", producer_id
               ORDER BY arrival_ms, attempt, tie
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ack_offset
    FROM marked LEFT JOIN (SELECT tie AS t, attempt AS n, "offset" FROM wide) w
         ON w.t = marked.tie AND w.n = marked.attempt""", "marked", "wide")


def _audit(source: str) -> str:
    return _with(f"""
        SELECT *, first_offset = 0 AND duplicates = 0 AND missing = 0 AS contiguous FROM (
            SELECT "partition", count(*) AS records, min("offset") AS first_offset, max("offset") AS last_offset,
                   count(DISTINCT "offset") AS distinct_offsets,
                   count(*) - count(DISTINCT "offset") AS duplicates,
                   max("offset") + 1 - count(DISTINCT "offset") AS missing
            FROM {source} GROUP BY 1)""", source)


def sql() -> dict:
    return {
        "window_agg": _agg("sensor", SIZE),
        "window_agg_10s": _agg("sensor", 10_000),
        "window_agg_shipments": _agg("ship", WEEK),
        "window_agg_accepted": _agg("latew", SIZE, "NOT late"),
        "windows_completed": _agg("sensor", SIZE, _DONE),
        "windows_active": _agg("sensor", SIZE, f"NOT ({_DONE})"),
        "window_rollup": _agg("ship", 4 * WEEK),
        "stream_window_agg": _agg("sensor", SIZE, _DONE),
        "stream_log_to_windows": _agg("sensor", SIZE, _DONE),
        "log_fan_in": _agg("(SELECT device_id, temperature, event_ms FROM sensor UNION ALL SELECT * FROM ship)",
                           WEEK, names=("sensor", "ship")),
        "window_assign": _with("""
            SELECT event_id, event_ms - event_ms % 10000 AS window_start_ms,
                   event_ms - event_ms % 10000 + 10000 AS window_end_ms FROM sensor""", "sensor"),
        "window_label": _with(f"""
            SELECT device_id, ws AS window_start_ms,
                   'Window[' || device_id || '@[' || ws || ',' || (ws + {SIZE}) || ')] -> count=' || n || ', avg='
                   || {_ONE_DP.format('s / n')} || ', max=' || {_ONE_DP.format('m')} AS label
            FROM (SELECT device_id, event_ms - event_ms % {SIZE} AS ws, count(*) AS n,
                         round(sum(temperature), 2) AS s, max(temperature) AS m
                  FROM sensor GROUP BY 1, 2)""", "sensor"),
        "window_conservation": _with("""
            SELECT count(*) AS consumed, count_if(NOT late)::BIGINT AS accepted,
                   (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM latew WHERE NOT late
                                                GROUP BY device_id, ws)) AS readings,
                   TRUE AS conserved FROM latew""", "latew"),
        "run_counters": _with(f"""
            SELECT sum(a)::BIGINT AS processed, sum(l)::BIGINT AS late,
                   count_if(a > 0 AND NOT done)::BIGINT AS active_windows,
                   count_if(a > 0 AND done)::BIGINT AS flushed_windows
            FROM (SELECT device_id, ws, count_if(NOT late) AS a, count_if(late) AS l,
                         ws + {SIZE} + {GRACE} <= (SELECT max(arrival_ms) FROM late) AS done
                  FROM latew GROUP BY 1, 2)""", "latew"),
        "latency_percentiles_ns": """
            SELECT event_type, """ + ", ".join(
            f"min(CASE WHEN rn = greatest(1, ceil({p} / 100.0 * n)) THEN ns END) AS p{p}" for p in (50, 95, 99)) + """
            FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ns) AS rn,
                         count(*) OVER (PARTITION BY event_type) AS n
                  FROM (SELECT event_type, round(value * 100)::BIGINT * 10000000 + user_id * 997 AS ns FROM events))
            GROUP BY event_type""",
        "window_quantiles": _with(f"""
            SELECT device_id, ws AS window_start_ms, ws + {4 * WEEK} AS window_end_ms, count(*) AS count, """ + ", ".join(
            f"min(CASE WHEN rn >= {p} / 100.0 * n THEN temperature END) AS p{p}" for p in (50, 95, 99)) + f"""
            FROM (SELECT *, row_number() OVER (PARTITION BY device_id, ws ORDER BY temperature) AS rn,
                         count(*) OVER (PARTITION BY device_id, ws) AS n
                  FROM (SELECT *, event_ms - event_ms % {4 * WEEK} AS ws FROM ship ))
            GROUP BY device_id, ws""", "ship"),
        "replica_damage": _with("""SELECT * FROM diff WHERE status <> 'same'""", "diff"),
        "stream_late_counts": _with("""
            SELECT count_if(verdict = 'processed')::BIGINT AS processed, count_if(verdict = 'late')::BIGINT AS late,
                   count_if(verdict = 'dropped')::BIGINT AS dropped FROM verdicts""", "verdicts"),
        "stream_open_windows": _with(f"""
            SELECT device_id, ws AS window_start_ms, ws + {SIZE} AS window_end_ms, count(*) AS count,
                   round(sum(temperature), 2) AS sum, round(sum(temperature), 2) / count(*) AS avg, max(temperature) AS max,
                   ws + {SIZE} > (SELECT max(event_ms) - {GRACE} FROM verdicts) AS open
            FROM verdicts WHERE verdict = 'processed' GROUP BY device_id, ws""", "verdicts"),
        "late_accept": _with(f"SELECT {_LATE} FROM latew WHERE NOT late", "latew"),
        "late_rejects": _with(f"SELECT {_LATE} FROM latew WHERE late", "latew"),
        "late_arrivals": _with("SELECT event_id, device_id, event_ms, arrival_ms FROM late", "late"),
        "lateness_profile": _with("""
            SELECT event_type, count(*) AS events, count_if(arrival_ms - event_ms > 500)::BIGINT AS late,
                   count_if(arrival_ms - event_ms <= 500)::BIGINT AS on_time,
                   max(arrival_ms - event_ms) AS max_lateness_ms FROM late GROUP BY 1""", "late"),
        "round_half_up_1dp": "SELECT event_id, floor(value * 10 + 0.5) / 10 AS rounded FROM events",
        "event_to_json": _with("""SELECT event_id, value FROM (SELECT tie AS event_id, value FROM attempts
            WHERE attempt = 0)""", "attempts"),
        "dead_letters": _with("""
            SELECT event_id, CASE WHEN event_id % 10 = 3 THEN substring(v, 1, length(v) - 7)
                                  ELSE '{"deviceId":"' || key || '"}' END AS value
            FROM (SELECT event_id, key, value AS v FROM numbered) WHERE event_id % 10 IN (3, 5)""", "numbered"),
        "key_partition": _with("""
            SELECT event_id, h AS key_hash, (h % 4)::INTEGER AS "partition" FROM hashed""", "hashed"),
        "key_hash_text": _UTF16,
        "log_scan": _with('SELECT "partition", "offset", key, value, "timestamp" FROM log', "log"),
        "log_fetch": _with("""
            SELECT "partition", "offset", key, value, "timestamp" FROM log
            WHERE "partition" = 2 AND "offset" >= 100""", "log"),
        "log_append": _with(f"SELECT {_LOG} FROM log", "log"),
        "event_from_json": _with("""
            SELECT w."partition", w."offset", s.device_id, s.temperature, s.event_ms
            FROM wide w JOIN sensor s ON s.event_id = w.tie""", "wide", "sensor"),
        "append_attempts": _with(f"SELECT {_ATTEMPT} FROM attempts", "attempts"),
        "idempotent_dedup": _with(f"SELECT {_ATTEMPT} FROM kept", "kept"),
        "idempotent_dedup_sliced": _with(f"SELECT {_ATTEMPT} FROM kept", "kept"),
        "log_offsets": _with(f"SELECT {_LOG} FROM log", "log"),
        "log_offsets_sliced": _with(f"SELECT {_LOG} FROM log", "log"),
        "stream_dedup": _with(f"SELECT {_LOG} FROM log", "log"),
        "append_plain": _with("""
            SELECT "partition", row_number() OVER (PARTITION BY "partition" ORDER BY arrival_ms, attempt, tie) - 1
                   AS "offset", key, value, arrival_ms AS "timestamp", producer_id, seq FROM attempts""", "attempts"),
        "append_acks": _ACKS,
        "append_acks_sliced": _ACKS,
        "producer_state": _with("""
            SELECT "partition", producer_id, max(seq) AS last_seq, max("offset") AS last_offset
            FROM log GROUP BY 1, 2""", "log"),
        "log_end_offsets": _with("""
            SELECT "partition", count(*) AS records, max("offset") + 1 AS next_offset FROM log GROUP BY 1""", "log"),
        "consumer_progress": _with("""
            SELECT "partition", count(*) AS events_processed, max("offset") + 1 AS next_offset
            FROM log WHERE "offset" >= 100 GROUP BY 1""", "log"),
        "latency_percentiles": _with(
            f"SELECT event_type, {_ranks('')} FROM {_ordered('event_type')} GROUP BY 1", "lat"),
        "latency_percentiles_all": _with(f"SELECT {_ranks('')} FROM {_ordered('')}", "lat"),
        "latency_summary": _with(f"""
            SELECT (SELECT count(*) FROM lat WHERE success) AS succeeded,
                   (SELECT count(*) FROM lat WHERE NOT success) AS failed, p50, p95, p99
            FROM (SELECT {_ranks('')} FROM {_ordered('', 'success')})""", "lat"),
        "latency_summary_by_user": _with(f"""
            SELECT b.user_id, succeeded, failed, coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95,
                   coalesce(p99, 0) AS p99
            FROM (SELECT user_id, count_if(success)::BIGINT AS succeeded, count_if(NOT success)::BIGINT AS failed
                  FROM lat GROUP BY 1) b
            LEFT JOIN (SELECT user_id, {_ranks('')} FROM {_ordered('user_id', 'success')} GROUP BY 1) r
                 ON r.user_id = b.user_id""", "lat"),
        "throughput": """
            SELECT event_type, count(*) AS events, (count(*) // 2592000)::BIGINT AS whole_per_sec,
                   count(*) / 2592000.0::DOUBLE AS per_sec FROM events GROUP BY 1""",
        "throughput_by_bucket": _with(f"""
            SELECT event_ms - event_ms % {HOUR} AS bucket_start_ms, count(*) AS events,
                   (count(*) * 1000 // {HOUR})::BIGINT AS whole_per_sec,
                   count(*) * 1000.0::DOUBLE / {HOUR}.0::DOUBLE AS per_sec FROM sensor GROUP BY 1""", "sensor"),
        "reconcile_loss": _with("""
            SELECT p."partition", produced, coalesce(consumed, 0) AS consumed,
                   produced - coalesce(consumed, 0) AS difference,
                   greatest(0, produced - coalesce(consumed, 0)) AS lost
            FROM (SELECT "partition", count(*) AS produced FROM log GROUP BY 1) p
            LEFT JOIN (SELECT "partition", count(*) AS consumed FROM consumed GROUP BY 1) c
                 ON c."partition" = p."partition" """, "log", "consumed"),
        "lost_records": _with("""SELECT "partition", "offset", key FROM log WHERE "offset" % 97 = 0""", "log"),
        "lost_records_damaged": _with("""
            SELECT "partition", "offset", key FROM log WHERE "offset" % 97 = 0
            UNION ALL SELECT "partition", "offset", key FROM log WHERE "offset" % 97 = 0 AND "offset" % 89 = 0
            UNION ALL SELECT "partition", NULL, key FROM log WHERE "offset" % 83 = 0 AND "partition" = 1""", "log"),
        "log_append_repeated": _with(f"SELECT {_LOG} FROM log", "log"),
        "offset_audit": _audit("log"),
        "offset_audit_damaged": _audit("damaged"),
        "offset_duplicates": _with("""
            SELECT "partition", "offset", 2::BIGINT AS copies FROM log WHERE "offset" % 89 = 0""", "log"),
        "replica_diff": _with('SELECT "partition", "offset", status FROM diff', "diff"),
        "replica_summary": _with("""
            SELECT "partition", CASE status WHEN 'missing_right' THEN 'missing_left' ELSE status END AS status,
                   count(*) AS offsets FROM diff GROUP BY 1, 2""", "diff"),
        "device_liveness": _with(f"""
            SELECT r.device_id, last_seen_ms,
                   coalesce((SELECT max(event_ms) FROM sensor) - last_seen_ms <= {SIZE}, FALSE) AS alive
            FROM (SELECT 'device-' || c_custkey AS device_id FROM customer) r
            LEFT JOIN (SELECT device_id, max(event_ms) AS last_seen_ms FROM sensor GROUP BY 1) s
                 ON s.device_id = r.device_id""", "sensor"),
        "order_audit": _with("""
            SELECT "partition", count(*) AS records, count_if(seq <= prev)::BIGINT AS out_of_order,
                   0::BIGINT AS misrouted
            FROM (SELECT *, lag(seq) OVER (PARTITION BY "partition", producer_id ORDER BY "offset") AS prev FROM log)
            GROUP BY 1""", "log"),
        "key_placement": _with("""
            SELECT count(*) AS keys, count_if(n > 1)::BIGINT AS split_keys
            FROM (SELECT key, count(DISTINCT "partition") AS n FROM log GROUP BY 1)""", "log"),
        "run_verdict": _with("""
            SELECT failed, lost, failed <= 10 AND lost = 0 AS passed
            FROM (SELECT (SELECT count(*) FROM lat WHERE NOT success) AS failed,
                         (SELECT count(*) FROM log) - (SELECT count(*) FROM consumed) AS lost)""",
            "lat", "log", "consumed"),
    }
