from pyspark.sql import functions as F

from loomline.llm import garbled as g

SCHEMA = "doc_id long, text string, table_name string, parts int"
CLEAN = ["Le café et l’été à la forêt, déjà vu naïf.", "Größere Prüfer müde häufig.", "Bộ nhớ đầy, tác tử viết lại truy vấn", "“Quotes” — and dashes… €5 ½ ‰ ©", "NGÃ RẼ 37: BÃI ĐỖ XE", "SÃO PAULO", "検索拡張生成の評価", "👩‍💻 𝒳 → 🚀", "El niño corrigió línea por línea ¿qué?"]


def table(spark, rows):
    return spark.createDataFrame([(k, t, "x", 9) for k, t in rows], SCHEMA)


def test_chains_undo_themselves():
    for codec in g.CHAINS:
        for text in ("é", "ü", "’", "ê"):
            bad = g.garble(text, codec)
            if bad and bad != text:
                assert (0, len(bad), text) in g.candidates(bad, codec), (codec, text)


def test_found_and_restored(spark):
    damaged = {}
    rows = [(i, t) for i, t in enumerate(CLEAN * 30)]
    for n, codec in enumerate(("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "gbk")):
        good = "Un café déjà là, l’été à Paris"
        bad = "".join(g.garble(c, codec) or c if c > "\x7f" else c for c in good)
        damaged[1000 + n] = good
        rows.append((1000 + n, bad))
    twice = g.garble(g.garble("été", "cp1252"), "cp1252")
    rows += [(2000, f"x {twice} y"), (2001, "lost � here"), (2002, None), (2003, ""), (None, "café Ã©"), (2004, "abc " * 100_000 + "Ã©té")]
    damaged[2000] = "x été y"
    out = {r["record_id"]: r for r in g.garbled({"t": (table(spark, rows), "doc_id")}).collect()}
    assert set(map(int, out)) == set(damaged) | {2001, 2004}
    assert all(out[str(k)]["restored"] == v for k, v in damaged.items())
    assert out["2001"]["lost"] == 1 and out["2001"]["restored"] == "lost � here"


def test_empty_and_clean(spark):
    assert g.garbled({"t": (table(spark, []), "doc_id")}).count() == 0
    assert g.garbled({"t": (table(spark, [(i, t) for i, t in enumerate(CLEAN)]), "doc_id")}).count() == 0


def test_margin_comes_from_all_windows_and_all_meetings(spark):
    texts = [f"{a}{b}{c} x {d}{a}" for a in "éüêÃâ" for b in "aébßÐ" for c in "è’©™²" for d in "ñ±¤Â"]
    windows = g.clean_windows(spark.createDataFrame([(t,) for t in texts], "text string")).persist()
    model = g.train(windows)
    ws = [r["w"] for r in windows.collect()]
    runs = {r for w in ws for r in g._RUN.findall(w)}
    wrong = [round(model.gain(a + b, s, e, n), 6) for a in runs for b in runs for s, e, n, _ in g.repeated(a + b) if model.knows(n)]
    pairs, tried = g.meetings(windows)
    met = [round(model.gain(r["tail"] + r["head"], s, e, n), 6) for r in pairs.collect() for _ in range(r["n"]) for s, e, n, _ in g.repeated(r["tail"] + r["head"]) if model.knows(n)]
    assert wrong and sorted(wrong) == sorted(met) and tried == len(runs) ** 2
    counts = spark.sparkContext.broadcast(model.counts)
    right, times = g._tallied(windows.select("w", F.lit(1).alias("n")), counts, g._right_gains)
    assert times.sum() == sum(len(g._right_gains(model, (w, 1))) for w in ws) and len(ws) > 50
    found = g.validated_margin(model, windows)
    lost = lambda m: times[right <= m].sum() / times.sum() + g.MEETINGS * 5 * sum(x > m for x in wrong) / tried
    assert lost(found) <= min(lost(m) for m in [0.0, *right, *wrong]) + 1e-3
