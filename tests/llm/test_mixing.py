from collections import Counter

from augeval.llm.mixing import cycle_slots, schedule, weights


def test_cycle_meets_every_window(spark, frame):
    n = {"a": 5000, "b": 300, "c": 20, "d": 1, "e": 20}
    shares = weights(frame(list(n.items()), "src string, n long"), 100)
    share = {r.src: r.share for r in shares.collect()}
    assert sum(share.values()) == 100 and min(share.values()) >= 1 and share["a"] > share["b"] > share["c"] == share["e"]
    rows = sorted(cycle_slots(shares, 100).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(100))
    done = Counter()
    for r in rows:
        assert r.release <= r.slot < r.deadline
        done[r.src] += 1
        assert all(abs(done[s] - share[s] * (r.slot + 1) / 100) < 1 for s in share)  # less than one block off


def test_schedule_keeps_all_rows_and_columns(spark, frame):
    rows = [(i if i % 11 else None, f"t{i}", [None, "", "x", "y"][i % 4] if i % 3 else "hot", i) for i in range(500)] + [(7, "t7", "hot", 7)] * 3
    d = frame(rows, "doc_id long, text string, source string, slot int")
    got = schedule(d, block_docs=4, cycle=20).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter((a, b, c) for a, b, c, _ in rows)
    by = Counter((r.source or "", r.block) for r in got)
    assert all(n == 4 for (s, b), n in by.items() if (s, b + 1) in by)
    assert len({(r.source or "", r.block): r.slot for r in got}) == len({r.slot for r in got})
    assert len({(r.source or "", r.block, r.place) for r in got}) == len(got)


def test_empty(spark, frame):
    assert schedule(frame([], "doc_id long, source string")).count() == 0


def test_more_sources_than_slots(spark, frame):
    rows = [(i, f"s{i % 60:02d}" if i < 300 else "hot") for i in range(2000)]
    got = schedule(frame(rows, "doc_id long, source string"), block_docs=1, cycle=20).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows)
    assert len({r.slot for r in got}) == len(rows) and all(r.release <= r.slot < r.deadline for r in got)
    turn = 20 * 31  # 61 sources, 10 slots each or more
    first = Counter(r.source for r in got if r.slot < turn)
    light = [first[f"s{i:02d}"] for i in range(60)]
    root = {"hot": 1700 ** 0.5, "light": 5 ** 0.5}
    share = turn * root["hot"] / (root["hot"] + 60 * root["light"])
    assert abs(first["hot"] - share) < 0.1 * share and min(light) == max(light) == 5  # a light source has five blocks in all
    hot = [sum(r.source == "hot" for r in got if r.slot < k * turn // 10) for k in range(1, 11)]
    assert all(abs(h - first["hot"] * k / 10) < 0.1 * first["hot"] for k, h in enumerate(hot, 1))


def test_long_cycle_meets_every_window(spark, frame):
    n = {f"s{i:03d}": 1 + (i * i) % 97 for i in range(150)} | {"hot": 100_000}
    groups, cycle = 8, 40
    shares = weights(frame(list(n.items()), "src string, n long"), groups * cycle)
    rows = sorted(cycle_slots(shares, cycle, groups).collect(), key=lambda r: r.slot)
    share = {r.src: r.share for r in shares.collect()}
    assert [r.slot for r in rows] == list(range(groups * cycle)) and Counter(r.src for r in rows) == share
    assert all(r.share == share[r.src] and r.release <= r.slot < r.deadline for r in rows)
