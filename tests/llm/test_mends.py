"""Cases that earlier versions got wrong: resumed shards, small shares of a sample, prose of other languages, rows alike at a
cut, pages with end tags that nothing opened."""

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from spanquarry.llm import common, html, mixing, quality, tokens, toxicity

SF = "/root/testdata/sf0.01"

PROSE = {
    "pl": "Rada miasta przyjęła wczoraj nowy plan zagospodarowania terenów nad rzeką, który przewiduje budowę parku, ścieżek rowerowych oraz niewielkiej przystani dla łodzi. Mieszkańcy od lat domagali się zmian, ponieważ brzeg był zaniedbany i trudno dostępny. Prace mają ruszyć jesienią, a ich koszt oszacowano na czternaście milionów złotych. Część środków pochodzi z funduszy europejskich. Burmistrz zapewnił, że drzewa zostaną zachowane, natomiast stare magazyny czeka rozbiórka albo remont.",
    "fi": "Kaupunginvaltuusto hyväksyi eilen uuden suunnitelman, jonka mukaan joen rantaan rakennetaan puisto, pyöräteitä sekä pieni venesatama. Asukkaat ovat toivoneet muutosta vuosien ajan, koska ranta on ollut huonossa kunnossa ja vaikeasti saavutettavissa. Työt alkavat syksyllä, ja niiden hinnaksi on arvioitu neljätoista miljoonaa euroa. Osa rahoista saadaan Euroopan unionilta. Pormestari lupasi, että vanhat puut säilytetään, mutta tyhjät varastot puretaan tai korjataan. Rakentaminen kestää kaksi vuotta, ja liikenne ohjataan sillä välin toista kautta.",
    "tr": "Belediye meclisi dün akşam nehir kıyısı için hazırlanan yeni planı kabul etti. Plana göre bölgede bir park, bisiklet yolları ve küçük tekneler için bir iskele yapılacak. Mahalle sakinleri yıllardır değişiklik istiyordu, çünkü kıyı bakımsızdı ve ulaşmak zordu. Çalışmalar sonbaharda başlayacak, maliyetin on dört milyon lirayı bulması bekleniyor. Paranın bir bölümü Avrupa fonlarından karşılanacak. Başkan ağaçların korunacağını, eski depoların ise yıkılacağını ya da onarılacağını söyledi. İnşaat iki yıl sürecek.",
    "id": "Dewan kota kemarin menyetujui rencana baru untuk kawasan tepi sungai, yang mencakup taman, jalur sepeda, serta dermaga kecil bagi perahu. Warga sudah bertahun-tahun meminta perubahan karena tepi sungai itu kurang terawat dan sulit dijangkau. Pekerjaan akan dimulai pada musim hujan dengan biaya sekitar empat belas miliar rupiah. Sebagian dananya berasal dari pemerintah pusat. Wali kota berjanji bahwa pohon-pohon tetap dipertahankan, sedangkan gudang lama akan dibongkar atau diperbaiki. Pembangunan berlangsung selama dua tahun.",
    "vi": "Hội đồng thành phố hôm qua đã thông qua kế hoạch mới cho khu vực ven sông, bao gồm một công viên, đường dành cho xe đạp và một bến nhỏ cho thuyền. Người dân nhiều năm nay mong muốn thay đổi vì bờ sông bị bỏ hoang và khó tiếp cận. Công việc sẽ bắt đầu vào mùa thu với chi phí khoảng mười bốn tỷ đồng. Một phần tiền đến từ ngân sách quốc gia. Thị trưởng hứa rằng cây cối sẽ được giữ lại, còn những nhà kho cũ sẽ bị phá bỏ hoặc sửa chữa.",
    "sw": "Baraza la jiji lilipitisha jana mpango mpya wa eneo la kando ya mto, ambao unajumuisha bustani, njia za baiskeli na gati dogo la mashua. Wakazi wameomba mabadiliko kwa miaka mingi kwa sababu ukingo wa mto ulikuwa umetelekezwa na ilikuwa vigumu kuufikia. Kazi itaanza msimu wa mvua kwa gharama ya takriban shilingi bilioni kumi na nne. Sehemu ya fedha itatoka serikali kuu. Meya aliahidi kwamba miti itahifadhiwa, lakini maghala ya zamani yatabomolewa au kukarabatiwa. Ujenzi utachukua miaka miwili.",
}
JUNK = " | ".join(f"{w}{k}" for k in range(20) for w in ("menu", "Login", "cart", "rss"))


def test_prose_of_other_languages_stays_and_junk_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-k - 1, t) for k, t in enumerate([*PROSE.values(), JUNK])], "doc_id long, text string")
    found = {r.doc_id: r for r in quality.judge(docs.unionByName(more)).where("doc_id < 0").collect()}
    assert {lang: found[-k - 1].kept for k, lang in enumerate(PROSE)} == dict.fromkeys(PROSE, True)
    assert not found[-len(PROSE) - 1].kept and all(r.n_words >= quality.MIN_WORDS for r in found.values())


def test_resumed_shards_do_not_depend_on_the_input_splits(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    path, kinds = f"file://{tmp_path}/shards", ["slot", "shard", "offset", "doc_id", "seq_no", "n_tokens", "tokens"]
    first = tokens.training_order(docs, per_shard=100, path=path).select(kinds).toPandas().sort_values("slot")
    gone = sorted(p for p in os.listdir(tmp_path / "shards") if p.startswith("shard="))[::2]
    for p in gone:
        for f in os.listdir(tmp_path / "shards" / p):
            (tmp_path / "shards" / p / f).unlink()
    again = tokens.training_order(docs.repartition(13, "text"), per_shard=100, path=path).select(kinds).toPandas().sort_values("slot")
    assert len(gone) > 5 and len(first) == len(again) == len(set(zip(again.doc_id, again.seq_no, strict=True)))
    assert all((first[c].to_numpy() == again[c].to_numpy()).all() for c in kinds)
    other = tokens.training_order(docs.repartition(5), per_shard=100).select(kinds).toPandas().sort_values("slot")
    assert all((first[c].to_numpy() == other[c].to_numpy()).all() for c in kinds)


def test_shards_of_another_run_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(k, "word " * k) for k in range(40)], "doc_id long, text string")
    path = f"file://{tmp_path}/shards"
    tokens.training_order(docs, seq=16, per_shard=8, path=path)
    for wrong in (docs.where("doc_id > 0"), docs.withColumn("text", F.concat("text", F.lit("x")))):
        with pytest.raises(ValueError, match="another run"):
            tokens.training_order(wrong, seq=16, per_shard=8, path=path)
    with pytest.raises(ValueError, match="another run"):
        tokens.training_order(docs, seq=16, per_shard=8, key=1, path=path)


@pytest.mark.parametrize("share", [1.0, 0.5, 1e-3, 1e-7, 3e-9])
def test_shares_below_a_millionth_still_choose(spark, share):
    n = 1_000_000
    low = spark.range(n).where(common.lowest_share(F.expr(f"cast(id * {2**64 // n}BD - {2**63}BD AS long)"), share)).count()
    assert low == pytest.approx(max(1, n * share), abs=1)


def test_labelled_rows_are_bounded_by_rows(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(docs.limit(500)).unionByName(spark.createDataFrame([(k, f"other {k}") for k in range(8, 30)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(7, 30)], "doc_id long, quality long, toxic long")
    rows = toxicity.training_rows(docs, labels, sample=100).collect()
    assert len(rows) == len({(r.doc_id, r.text) for r in rows}) == 100
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(toxicity.training_rows(docs.repartition(7), labels, sample=100).collect())]


@pytest.mark.parametrize("ids", [lambda k: 5, lambda k: None, lambda k: k % 7])
def test_rows_alike_are_cut_where_the_target_lies(spark, tmp_path, ids):
    rows = [(ids(k), "ten words " * 5, "a") for k in range(1000)] + [(2000 + k, "one two three " * (k % 5), "bc"[k % 2]) for k in range(300)] + [(1, None, None), (2, "", None), (None, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = mixing.mix(common.cut(mixing.sized(docs))).select("doc_id", "size", F.col("pattern_size").alias("source_size"), F.col("quota").alias("target"), "taken", "source").collect()
    assert len(found) == len(rows)
    for source in "abc":
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert all(r.taken <= 2 * r.size for r in mine)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple(x if x is not None else -1 for x in r)
    assert sorted(key(tuple(r)[:5]) for r in found) == sorted(map(key, con.execute(mixing.ORACLE).fetchall()))
    assert mixing.mixed_documents(docs).count() == sum(r.taken // r.size for r in found if r.size)


def test_end_tags_of_nothing_cost_no_walk():
    def took(k):
        began = time.perf_counter()
        html.parse("<div>" * k + "</section>" * k + "<p>end</p>")
        return time.perf_counter() - began

    took(1000)
    assert took(16_000) < 12 * max(took(4000), 0.01)
    tree = html.parse("<div><ul><li>a<li>b</ul></span></p></div><p>c")
    assert [n.tag for n in tree.kids] == ["div", "p"] and [n.tag for n in tree.kids[0].kids[0].kids] == ["li", "li"]
