"""Event-time streams: late and repeated arrivals, timers without further events, cleared state."""
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

from quern.streaming import streams as ST, timed as TM

DAY = 86400


def streamed(spark, tmp_path, batches, schema, make):
    """Runs ``make`` over files that arrive one after the other."""
    folder = tmp_path / "in"
    folder.mkdir()
    for n, rows in enumerate(batches):
        kinds = {"long": pa.int64(), "double": pa.timestamp("us", "UTC"), "string": pa.string(), "boolean": pa.bool_()}
        fields = [c.split() for c in schema.split(", ")]
        columns = [[round(v * 1e6) if name == "ts" and v is not None else v for v in column] for (name, _), column in zip(fields, zip(*rows))]
        pq.write_table(pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields]), folder / f"{n:03d}.parquet")
        os.utime(folder / f"{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    source = spark.readStream.schema(schema.replace("ts double", "ts timestamp")).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
    return ST.run_to_end(make(source)).collect()


def arrivals(events, rng, late=1800):
    """Batches in the order of arrival; an event comes up to half an hour late. A last heartbeat lets the watermark pass all."""
    order = sorted(events, key=lambda e: e[1] + rng.random() * late)
    cuts = [order[i:i + 40] for i in range(0, len(order), 40)]
    return [*cuts, [(-1, 10_000 * DAY, None, *([None] * (len(events[0]) - 3)))]]


def plain_cap(events, limit, seconds, mark, closed):
    out = {}
    logs = {}
    for event, ts, key, *_ in sorted(events, key=lambda e: (e[1], e[0])):
        log = [u for u in logs.get(key, []) if round((ts - u) * 1e6) < seconds * 1_000_000 + closed]
        out[event] = len(log) < limit
        if out[event] or mark and len(log) == limit:
            log.append(ts)
        logs[key] = log
    return out


def events_of(rng, n=240):
    return [(k, rng.choice([0, 0.5, 1]) + rng.randrange(0, 6 * 3600), rng.choice("abc")) for k in range(n)]


def test_caps_do_not_depend_on_arrival(spark, tmp_path):
    for seed, mark, closed in ((1, False, False), (2, True, True)):
        rng = random.Random(seed)
        events = events_of(rng)
        folder = tmp_path / str(seed)
        folder.mkdir()
        rows = streamed(spark, folder, arrivals(events, rng), "event_id long, ts double, who string", lambda s: TM.capped(s, "who", 3, 600, mark, closed))
        assert {r["event_id"]: r["accepted"] for r in rows if r["key"] is not None} == plain_cap(events, 3, 600, mark, closed)


def test_last_items_are_sent_without_another_event(spark, tmp_path):
    events = [(1, 1000.0, "a", True), (2, 1001.0, "a", True), (3, 1500.0, "a", False), (4, 1000.0, "b", False), (5, 9000.0, "a", True)]
    rows = streamed(spark, tmp_path, [events[:2], events[2:4], events[4:], [(-1, 10_000.0 * DAY, None, None)]], "event_id long, ts double, who string, success boolean",
                    lambda s: TM.digests(s.fillna({"success": True}), "who", 3600))
    found = sorted((r["key"], r["us"] // 1_000_000, r["succeeded"], r["failed"], r["kind"]) for r in rows if r["key"])
    assert found == [("a", 1000, 1, 0, "SUCCESS"), ("a", 4600, 1, 1, "PARTIAL"), ("a", 9000, 1, 0, "SUCCESS"), ("b", 1000, 0, 1, "FAILURE")]


def test_messages_land_once(spark, tmp_path):
    def attempt(body, number):
        return {"poison": "failed", "never": "transient", "third": "ok" if number == 3 else "transient"}.get(body, "ok")

    rows = [("m1", 100.0, "fine"), ("m2", 100.0, "third"), ("m3", 110.0, "poison"), ("m4", 120.0, "never"), ("m1", 130.0, "fine"), ("m2", 900.0, "third")]
    got = streamed(spark, tmp_path, [rows[:3], rows[3:], [("m1", 2000.0, "fine")], [(None, 10_000.0 * DAY, "beat")]], "msg_id string, ts double, body string",
                   lambda s: TM.landed(s, attempt))
    found = sorted((r["msg_id"], r["status"], r["attempts"], r["us"] // 1_000_000) for r in got if r["msg_id"])
    assert found == [("m1", "ok", 1, 100), ("m2", "ok", 3, 1000), ("m3", "failed", 1, 110), ("m4", "failed", 3, 1020)]


def test_messages_share_buckets(spark, tmp_path):
    """Messages of one bucket are judged apart: by their own time, repeated, late or without a time."""
    def attempt(body, number):
        return "transient" if body is None or body.endswith("3") and number < 3 else "ok"

    rows = [(f"m{k}", 1000.0 + 60 * (k % 7), f"body {k}") for k in range(200)] + [("none", 500.0, None), ("timeless", None, "body 3")]
    again = [(m, t + 300 if t else t, b) for m, t, b in rows[::3]]
    got = streamed(spark, tmp_path, [rows, again, [("m5", 9000.0, "body 5")], [(None, 10_000.0 * DAY, "beat")]], "msg_id string, ts double, body string",
                   lambda s: TM.landed(s, attempt, buckets=2))
    found = {r["msg_id"]: (r["status"], r["attempts"], r["us"] and r["us"] // 1_000_000) for r in got if r["msg_id"]}
    assert len([r for r in got if r["msg_id"]]) == len(found) == 202
    assert found == {f"m{k}": ("ok", 3 if k % 10 == 3 else 1, 1000 + 60 * (k % 7) + (900 if k % 10 == 3 else 0)) for k in range(200)} | {
        "none": ("failed", 3, 1400), "timeless": ("ok", 3, None)}


def test_mail(spark):
    from quern.sources import mail
    plain = "Subject: =?iso-8859-1?Q?Caf=E9_menu?=\nFrom: a@b.org\n\nfirst line\nsecond"
    odd = ('Subject: Menu\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="x"\n\n--x\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n<b>=C3=A9</b>\n'
           '--x\nContent-Type: text/plain; charset=no-such-set\n\nbody\n--x\nContent-Type: text/plain\nContent-Disposition: attachment; filename="a.txt"\n\nleft out\n--x--\n')
    d = spark.createDataFrame([(1, plain), (2, odd), (3, None), (4, " "), (5, "no headers at all")], "k int, raw string")
    found = {r["k"]: r for r in mail.messages(d, "raw").collect()}
    assert (found[1]["subject"], found[1]["plain"], found[1]["sender"]) == ("Café menu", "first line\nsecond", "a@b.org")
    assert (found[2]["html"].strip(), found[2]["plain"].strip(), found[2]["attachments"]) == ("<b>é</b>", "body", 1)
    assert found[3]["subject"] is None and found[4]["plain"] is None and found[3]["attachments"] == 0
    assert {r["k"] for r in mail.messages(d, "raw", "menu").collect()} == {1, 2}
