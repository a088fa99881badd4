"""HTML pages as elements, and the cards of listing pages."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import urls as U
from tidewell.operators import pages as P
from tidewell.sources import cards as C
from tidewell.sources import html as H
from tidewell.sources import tree as R


def pages(spark, *html):
    return spark.createDataFrame([(i, h, "clash", "clash") for i, h in enumerate(html)], "page_id long, html string, name string, text string")


def tree(spark, html):
    row = H.elements(pages(spark, html)).first()
    return [(e.name, " ".join(row.texts[e.texts : e.texts_end]), [x.name for x in row.elements[i + 1 : e.inner_end]]) for i, e in enumerate(row.elements)]


def test_elements_nest_and_unclosed_ones_end_with_what_is_around_them(spark):
    html = "<div><p>one<br>two<p>three</div></u><!-- <b>no</b> --><script>var t='<b>no</b>'</script><B CLASS='x'>four<i>five</b> six"
    assert tree(spark, html) == [("div", "one two three", ["p", "br", "p"]), ("p", "one two three", ["br", "p"]), ("br", "", []), ("p", "three", []), ("b", "four five", ["i"]), ("i", "five", [])]


def test_same_names_inside_each_other(spark):
    assert tree(spark, "<div>a<div>b</div>c</div>d<div>e</div>") == [("div", "a b c", ["div"]), ("div", "b", []), ("div", "e", [])]


def test_odd_pages(spark):
    df = pages(spark, None, "", "no tags < here & there", "</p></div>", "<a href=x>1</a>" * 3000)
    got = {r.key: (len(r.elements), len(r.texts)) for r in H.elements(df.unionByName(df)).collect()}
    assert got == {2: (0, 3), 4: (3000, 3000)}
    assert H.links(df.limit(0)).count() == 0


@pytest.mark.parametrize("raw, plain", [("a &amp;lt; b", "a &lt; b"), ("&#233;&#xE9;&eacute;", "ééé"), ("&nope; &amp &", "&nope; &amp &"), ("&#128077;&#0;", "\U0001f44d�"), (None, None)])
def test_unescape(spark, raw, plain):
    assert spark.createDataFrame([(raw,)], "t string").select(T.unescape(F.col("t"))).first()[0] == plain


@pytest.mark.parametrize(
    "href, want",
    [("/x/../y?q#f", "https://h.br/y?q"), ("z", "https://h.br/a/z"), ("//o/p", "https://o/p"), ("?k", "https://h.br/a/b?k"), ("", "https://h.br/a/b"), ("mailto:x", "mailto:x"), ("./c/", "https://h.br/a/c/"), (None, None)],
)
def test_joined_addresses(spark, href, want):
    assert spark.createDataFrame([(href,)], "h string").select(U.joined("https://h.br/a/b", F.col("h"))).first()[0] == want


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_portal_cards(spark):
    html = """<article><a href="https://gruposmartfit.99jobs.com/vagas/492613-professor"><h3>Smart Fit | Professor de Educa&ccedil;&atilde;o</h3><span>Assistente</span>
      <span>Presencial</span><span>São Luís, MA</span><span>SMARTFIT ESC DE GIN</span><span>4.33</span><span>Eu quero!</span></a></article>
      <article><h3>Estágio ENGIE</h3><a href="/engie/jobs/600001-estagio?utm_source=x">ver</a><span>Campinas - SP</span></article>
      <nav><a href="https://example.com"><h3>Para empresas</h3></a></nav><a href="https://linkedin.com/company/99jobs">LinkedIn</a>
      <a class="opportunity-card" href="https://carreiras.loja.com.br/job/123?jobId=ABC&amp;utm_source=99jobs"><h3>VENDEDOR(A)</h3><span>Presencial</span><span>Campinas, SP</span><span>Loja Boa</span><span>4.54</span><span>Eu quero!</span></a>
      <a href="https://www.99jobs.com/engie/jobs/600001-again">again</a>"""
    got = H.decode_cards(pages(spark, html, None), C.PORTAL, "99jobs")
    assert rows(got, "title", "company", "location", "workplace_type", "url") == [
        ("Estágio ENGIE", "Engie", "Estágio ENGIE ver Campinas, SP", None, "https://www.99jobs.com/engie/jobs/600001-estagio"),
        ("Smart Fit | Professor de Educação", "SMARTFIT ESC DE GIN", "São Luís, MA", "Presencial", "https://gruposmartfit.99jobs.com/vagas/492613-professor"),
        ("VENDEDOR(A)", "Loja Boa", "Campinas, SP", "Presencial", "https://carreiras.loja.com.br/job/123?jobId=ABC"),
    ]
    ids = {r.source_job_id for r in got.collect()}
    assert {"492613", "600001"} < ids and sum(i.startswith("external-") for i in ids) == 1


def test_board_cards(spark):
    html = '<ul><li><h2><a href="/vagas/v123/x">Estágio em Dados</a></h2><span>em</span><span>R$ 900</span><span>há 2 dias</span><span>ACME Ltda</span><span>Campinas / SP</span></li><li><a href="/vagas/v9/y">Analista</a><div>Recife - PE</div></li></ul>'
    assert rows(H.decode_cards(pages(spark, html), C.BOARD, "vagas_com"), "source_job_id", "company", "location", "employment_type") == [("123", "ACME Ltda", "Campinas / SP", "Estágio"), ("9", "Empresa não identificada", "Recife - PE", None)]


def test_regional_and_advertised_cards(spark):
    regional = '<div><h3>Quero esta vaga</h3><h4>Estágio TI</h4><p>Vagas ... GENESYS Manaus/AM Presencial R$ 1.200,00 12/03/2026</p><a href="/am/vaga/estagio/4711/estagio-ti">Quero esta vaga</a></div><p><a href="/SP/vaga/99/jovem-aprendiz">x</a></p>'
    assert rows(H.decode_cards(pages(spark, regional), C.REGIONAL, "iel"), "source_job_id", "title", "location", "employment_type", "salary", "published_at") == [
        ("iel:AM:4711", "Estágio TI", "Manaus, AM", "internship", "R$ 1.200,00", "2026-03-12"),
        ("iel:SP:99", "Jovem Aprendiz", "", None, None, None),
    ]
    advertised = '<div><h2>Vaga A</h2><span>Campinas, SP</span> estágio <a href="/vagas/12345-vaga-a">ver</a></div><div><h2>Vagas</h2> todas as vagas de hoje <a href="/vagas/">ver</a></div>'
    assert rows(H.decode_cards(pages(spark, advertised), C.ADVERTISED, "walljobs"), "source_job_id", "title", "location", "employment_type") == [("walljobs:12345", "Vaga A", "Campinas, SP", "internship")]


def test_look_back(spark):
    lines = [(1, i, t) for i, t in enumerate(["m", "x", "x", "x", "h", "m", "h", "h"])] + [(2, 0, "h"), (2, 1, None)]
    df = spark.createDataFrame(lines, "doc long, n long, t string")
    got = P.looked_back(df, "doc", "n", F.col("t") == "h", F.col("t") == "m", 3).where("t = 'h'")
    assert sorted((r.doc, r.n, r.mark) for r in got.collect()) == [(1, 4, None), (1, 6, 5), (1, 7, 5), (2, 0, None)]


def test_cards_of_lines(spark):
    cells = lambda *lines: "<main>" + "".join(f"<p>{x}</p>" for x in lines) + "</main>"
    html = cells("Menu", "ACME", "Auxiliar", "Recife", "6 horas", "R$ 800,00", "Superior", "Beta", "Gama", "Médio", "6 horas", "Olinda", "4 horas", "R$ 500", "x", "Técnico", "R$ 1", "Superior")
    assert rows(C.line_cards(pages(spark, html)), "company", "title", "location", "salary", "level", "workload") == [("ACME", "Auxiliar", "Recife", "R$ 800,00", "Superior", "6 horas")]


def test_programmes(spark):
    html = """<h2>Programa de Estágio ACME 2027</h2><p>text</p><a href="/inscricao/98765">Fazer inscrição</a><h2>Programa de Trainee Beta</h2><a href="/x">Inscrições encerradas</a>
      <h3>Jovem Aprendiz Gama</h3><h2>Programa de Estágio Delta</h2><div><h3>Programa Jovem Aprendiz Eta</h3><a href="/eta/4444">Sobre</a><button>Inscreva-se</button></div>"""
    assert rows(C.programmes(pages(spark, html)), "source_job_id", "title", "company", "employment_type") == [
        ("cia_estagios:4444", "Programa Jovem Aprendiz Eta", "Eta", "apprentice"),
        ("cia_estagios:98765", "Programa de Estágio ACME 2027", "ACME", "internship"),
    ]


def test_pages_are_not_merged_into_few_tasks(spark):
    plan = H.elements(pages(spark, "<p>a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [key#" in plan and f", {spark.conf.get('spark.sql.shuffle.partitions')}" in plan.split("RepartitionByExpression")[1].split("\n")[0]


def test_pages_are_read_as_their_tokens_say(spark):
    draw = random.Random(5)
    parts = ["<p>", "</p>", "<b class='T x'>", "</b>", "<i>", "</i>", "<a href=/x&amp;y>", "<A HREF=\"/q'>\">", "</a >", "<br/>", "</br>", "<li CLASS = k>", "</LI>", "<script x>var a='<b>'</script>", "</script>", "<style>", "<!-- <b> -->", "<!doctype html>", "<!--", "<", "a < b", "</", " \u00a0\u2003 ", "&nbsp;x  y\n", "&eacute;&#0;&#x1F44D;&nope;&amp;lt;", "\x1cz", "<a\u00e9 href>", "<\u017fcript>t"]
    html = ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(150)]
    told = {}
    for t in H.tokens(pages(spark, *html), "page_id", "html").where("not (kind = -1 and empty)").orderBy("key", "at").collect():
        told.setdefault(t.key, []).append(t)
    for i, page in enumerate(html):
        found, texts = R.page_elements(page)
        assert [(e[0], *e[2:5]) for e in found] == [(t.at, t.name, t.href, t.classes) for t in told.get(i, []) if t.kind == 1]
        assert texts == [t.text for t in told.get(i, []) if t.kind == 0]
        for j, e in enumerate(found):
            assert e[5] == sum(t.kind == 0 and t.at < e[0] for t in told[i]) and e[6] == sum(t.kind == 0 and t.at < e[1] for t in told[i])
            assert e[7] == j + 1 and e[8] == max(e[7], sum(x[0] < e[1] for x in found))
            if e[9] is not None:
                assert e[9] == [k for k in reversed(range(j)) if found[k][1] > e[0]]


def test_a_deep_page_costs_no_more_than_its_tokens(spark, monkeypatch):
    monkeypatch.setattr(R, "TOKENS", 100)
    deep = "<div>" * 200 + "<a href=x>1</a>" + "<a href=y>2" * 50
    [row] = H.elements(pages(spark, "", deep, None)).collect()
    assert all(e.up is None for e in row.elements) and H.links(pages(spark, deep), blocks=("div",)).where("block = 'div'").count() == 51
    batches = list(R.read_pages(iter([R.pa.RecordBatch.from_pydict({"key": list(range(9)), "html": ["<i>a</i>" * 30, None, "", *["<p>"] * 6]})])))
    assert [b.num_rows for b in batches] == [7] and batches[0].column(0).to_pylist() == [0, 3, 4, 5, 6, 7, 8]
    assert [b.num_rows for b in R.read_pages(iter([R.pa.RecordBatch.from_pydict({"key": list(range(4)), "html": ["<i>a</i>" * 60] * 4})]))] == [1] * 4


def test_cards_are_decoded_without_windows_over_tokens(spark):
    plan = H.decode_cards(pages(spark, "<p>a"), C.PORTAL, "99jobs")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "explode(regexp_extract_all" not in plan


def test_white_space_and_accents_of_mixed_texts(spark):
    texts = ["\u00c1 b\u00a0\u00a0c \ufb01x", "a  b", "\ta\u2003\u00e9\u0301", "\u00bd \u1e9b\u0323 Zo\u00eb", "plain", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.normalize(F.col("t"))).collect()]
    assert got == ["a b c fix", "a b", "a e", "1\u20442 s zoe", "plain", "", ""]
