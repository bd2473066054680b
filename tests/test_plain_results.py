"""Plain recogniser results are read by type, all others through the variant; both give the same boxes."""

import json
import re

from pyspark.sql import functions as F

from pagelayout.plans import catalog
from pagelayout.sources import images as im
from pagelayout.sources import views

SQUARE = "[[0,0],[10,1],[10,5.5],[0,5]]"
LINES = [
    f'[[{SQUARE},["a",0.5]]]', f'[{SQUARE},["a",0.5]]', '["a b \\u00e9\\" \\\\",1]', '["  \\u2003",1]', '["\\u2003",1]', '["\\n x\\t",1e-3]', '["\\u00a0y\\u2009",0.25]', '["12",7]', "[12,7]", "[true,1]", '["x","0.5"]', '["x",null]',
    '["x",false]', '[null,1]', '["",1]', '["x"]', '["x",-0.0]', '["[{",123456789012345678901234567890]', '["a]],[[b",1]', '["x",1,2]', '[{"k":[1]},1]', '["\\u0007",1]', '["😀 z",1E2]',
]
POINTS = ["[[0,0],[10,1],[10,5],[0,-0.0]]", "[[0,0],[-1,0],[10,5],[0,-5]]", "[[1e1,0],[10,1],[10,5],[0,5]]", "[[0,0],[10,1],[10,5],[0,5],[3,9]]", "[[0,0],[10,1],[10,5]]", "[[0,0],[10,1],[10,null],[0,5],[1,1]]", '[[0,0],[10,1],[10,"5"],[0,5]]', "[[0,0,7],[10,1],[10,5],[0,5]]", "[]"]


def raws():
    yield from ("[]", "[[]]", "[[],[]]", "[[null]]", "[null]", "[[0,0]]", "[[0, 0]]", "{}", "5", '"x"', "[[", "[[]", '[[]],"w":1', "[[]]]", "[[]] x", '[[{"text":"t","confidence":1,"corners":[1,2,3,4]}]]')
    lines = [x if x.startswith("[[") else f"[{SQUARE},{x}]" for x in LINES] + [f'[{p},["p",0.5]]' for p in POINTS]
    for x in lines:
        yield from (f"[[{x}]]", f'[[{x}, [{SQUARE}, ["z", 1]]]]', f"[[{x}],null,[{x},null,{x}]]", f"[{x}]", f"[[{x},,{x}]]", f"[[{x}{x}]]", f"[[{x},]]", f"[[{x}]][{x}]")
    yield f"[[{','.join([lines[2]] * 3000)}]]"
    texts, boxes = '"a"," ","é\\u2003",4.50,1e3,true,null,"z"', "[1,2,3,4],[1,2,3,4],[0,-0.0,2,2],[1,2,3,4],[1,2,3,4.5],[1,2,3,4],[1,2,3,4],[1,2,3,4]"
    for t in (texts, '"a","b","c"', '"a",5,1e3', '"a"', '"\\u2003"', '{"k":1},"b"', ""):
        for n in ("rec_texts", "texts"):
            for b in (f'"rec_boxes":[{boxes}]', '"boxes":[[1,2,3,4],[5,6,7,8],[1e1,0,-5,2]],"rec_boxes":[]', '"rec_boxes":[[1,2,3,4,5],[1,2],[1,2,3,null]]', '"rec_boxes":[[1,2,3,"4"]]', f'"rec_polys":[{SQUARE}],"rec_boxes":[{boxes}]', '"dt_polys":[],"boxes":[[1,2,3,4]]', '"boxes":5', '"other":1'):
                for s in ('"rec_scores":[0.5,"x",null,true]', '"scores":[0.5,0.25,1,1,1,1,1,1,1,1,1]', '"x":[{"y":1}]'):
                    page = f'{{"{n}":[{t}],{b},{s}}}'
                    yield page
                    if s[1] == "s":
                        yield from (f'{{"res":{page}}}', f'{{"data":{page},"input":"p.png"}}', f'{{"data":[{page}]}}')
    page = '{"texts":["a"],"boxes":[[1,2,3,4]]}'
    yield from (f'{{"res":{page},"data":{page}}}', f'{{"res":{page},"data":null}}', f'{{"res":{page},"res":{page}}}', f'{{"texts":["b"],"boxes":[[5,6,7,8]],"res":{page}}}', f'{{"texts":["b"],"res":{page}}}', f'{{"res":{{"res":{page}}}}}', f"{page},", f"{page}}}", f" {page} ")


def test_plain_results_give_the_boxes_of_the_general_way(spark, monkeypatch):
    d = spark.createDataFrame(list(enumerate(raws())), "image_id long, raw string").repartition(4).cache()
    said = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    quick = im.ingest_ocr_boxes(d)
    assert "from_json(" in quick._jdf.queryExecution().optimizedPlan().toString()
    deep = [("[" * n + x + "]" * m, n) for x in (LINES[0], LINES[1], "5", "[1,2]", '{"res":' + LINES[0] + "}", f"[{LINES[1]}]," + "[" * 20 + LINES[1] + "]" * 20) for n in (1, 6, 7, 8, 9, 15, 16, 17, 23, 24, 25, 28, 29, 30, 31, 32, 33, 40) for m in (n, n - 1)]
    opened = spark.createDataFrame(deep, "raw string, n int").select("n", F.explode(F.array(F.try_parse_json("raw"))).alias("v")).select("n", im._unwrapped(F.col("v")).alias("u")).repartition(4)
    paths = lambda: opened.selectExpr("n", "size(u.open) AS o", "to_json(u.done.path) AS p", "to_json(transform(u.done, x -> to_json(x.v))) AS v").collect()
    at_once = sorted(map(repr, paths()))
    got, left = said(quick), said(im.ocr_rejects(d))
    v, text = F.try_parse_json("raw"), F.col("raw")
    plain = d.select(F.count(F.when(v.isNotNull(), im._plain_lines(text))), F.count(F.when(v.isNotNull(), im._plain_page(v, text)))).head()
    assert min(plain) > 20
    monkeypatch.setattr(im, "_steady_signs", lambda raw: F.lit(False))
    monkeypatch.setattr(im, "_lines_only", lambda raw: F.lit(False))
    monkeypatch.setattr(im, "STRIDE", 100)
    opened = opened.sparkSession.createDataFrame(deep, "raw string, n int").select("n", F.explode(F.array(F.try_parse_json("raw"))).alias("v")).select("n", im._unwrapped(F.col("v")).alias("u"))
    assert at_once == sorted(map(repr, paths()))
    assert set(got) ^ set(said(im.ingest_ocr_boxes(d))) == set() and left == said(im.ocr_rejects(d))


def test_words_of_a_page_do_not_become_rows_before_they_are_results(spark, tmp_path):
    texts = [(2, "Ab  c\nd"), (2, "x \"q\" \\ é\t" + " w" * 130), (3, "one"), (3, None), (4, " \n"), (5, None), (6, "tail\n"), (-7, "neg ative ids"), (-70, " ".join("abcdefg" * 20)), (None, "no id"), (154, "broken"), (11, "deep"), (77, "both")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    known = catalog.registered()
    boxes = [r for r in views.boxes(spark, str(tmp_path)).collect() if r.image_id is not None]
    found = known["S3_ingest_ocr_boxes"].run(spark, str(tmp_path))
    want = {}
    for r in sorted(boxes, key=lambda r: (r.image_id, r.box_id, r.text)):
        want.setdefault(r.image_id, []).append((re.sub(r"^\s+|\s+$", "", r.text), r.confidence, r.l, r.t, r.r, r.b, 0.0))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.image_id, r.box_id)):
        assert r.box_id == len(got.setdefault(r.image_id, []))
        got[r.image_id].append(tuple(r)[2:])
    assert got == want
    left = known["S3_ocr_rejects"].run(spark, str(tmp_path))
    assert sorted(tuple(r) for r in left.collect()) == sorted([(k, "no JSON") for k in want if k % 7 == 0] + [(11, "nested too deep")])
    for d, times in ((found, 1), (left, 0)):
        assert d._jdf.queryExecution().optimizedPlan().toString().lower().count("posexplode") == times
    for raw in (r.raw for r in views.recogniser_json(spark, str(tmp_path)).collect()):
        json.loads(raw)
