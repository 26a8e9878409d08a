import pytest
from pyspark.sql import functions as F

from chanlake.llm import abuse, languages, mixing, personal, residue, samples


def kinds(text):
    return sorted({k for _, _, k in personal.find(text)})


def test_personal_kinds():
    yes = {
        "write to a.b+c@mx.example.org now": "email", "joe [at] example [dot] com": "email", "joe at example dot com": "email", "joe @ example . com": "email", "ｊoe＠example.com": "email", "jo​e@exam­ple.com": "email",
        "tel (030) 23125 343": "phone", "+44 7700 900123": "phone", "06.39.98.83.70": "phone", "555-555-0126": "phone", "07700900700": "phone", "plus zero zero four nine three zero two three one two five": "phone",
        "SSN 923-85-5304": "id_number", "DNI 00854916G": "id_number", "passport no. 904534529": "id_number", "паспорт 99 46 402751": "id_number",
        "lives at 164 Baker Lane, Flat 2": "address", "wohnt in der Lindenstraße 7": "address", "16 rue de Rivoli": "address", "calle Mayor 8, 6º B": "address", "ул. Ленина, д. 112, кв. 4": "address",
        "ask Peter Miller": "person", "MILLER Anna signed": "person", "Mrs Smithson": "person", "my name is clara johnson": "person", "Спросите Ольга Петрова": "person", "пан Коваленко прийшов": "person",
    }
    for text, kind in yes.items():
        assert kind in kinds(text), text
    for text in ("ask @peter or @anna_x", "IP 198.51.100.173", "version 4.69.48.1486", "kit@2.71.5", "Hotel Anna in Berlin", "Storm Peter passed Bergen", "Invoice 84-7617-73, total 12 632 736", "Main Street festival moved to hall 56", "ids 792800254 to 131699192", "on 25.6.2031 at 12:30", "", None):
        assert kinds(text) == [], text


GATED = {
    "Jean-Pierre Dupont wrote": "person", "Fragen an Hans-Peter Müller": "person", "г-н Иванов пришёл": "person", "г-жа Петрова пришла": "person", "Eilpaket für Xaver Zirngibl": "person", "Sig.ra Ferri": "person",
    "Steuer-ID 12 345 678 901": "id_number", "Personalausweis-Nr. 904534529": "id_number", "Dienstausweis: 904534529": "id_number", "RSSMRA85T10H501U": "id_number", "паспортом 904534529": "id_number", "sécurité sociale 904534529": "id_number",
    "пр-т Мира, 12": "address", "б-р Шевченко, 5": "address", "12, allée Verte": "address", "12 Baker Ct": "address", "12 Baker Dr": "address", "ViaRoma 12": "address", "Lindenweg7": "address", "A1-straße 5": "address", "улицаЛенина 12": "address",
    "oh-seven-seven-oh-oh-nine-oh-oh-one-two-three": "phone", "oh seven seven seven seven seven seven seven seven seven seven": "phone", "нуль п'ять п'ять п'ять п'ять п'ять п'ять п'ять п'ять п'ять": "phone", "ｏｈ ｓｅｖｅｎ seven oh oh nine oh oh one two three": "phone",
    "joe@example[.]com": "email", "joe@example [dot] com": "email",
}


def test_cheap_tests_lose_nothing(spark, sf, monkeypatch):
    import re

    for text, kind in GATED.items():
        assert kind in kinds(text), text
    for text in ("VIAGRA 50", "RUANDA 2024", "Task for Red Dragon"):
        assert kinds(text) == [], text
    texts = [*GATED, *(r[0] for r in spark.read.parquet(f"{sf}/messages.parquet").select("text").distinct().limit(400).collect())]
    gated = [personal.find(t) for t in texts]
    for name in ("some", "many", "parts", "holds"):
        monkeypatch.setattr(personal.Words, name, lambda *_: True)
    for name in ("_MANY", "_HINT"):
        monkeypatch.setattr(personal, name, re.compile(""))
    for t, x in zip(texts, gated):
        assert personal.find(t) == x, t


NAMES = "Priya Raman|Mehmet Yilmaz|Wei Zhang|Kwame Mensah|Agnieszka Kowalczyk|Ingeborg Haugland|Thabo Nkosi|Yuki Tanaka|Siobhan Gallagher|Rania Haddad|Bogumil Zielinski|Lieselotte Brinkmann|Thibault Carpentier|Ximena Arrieta|Anselmo Figueiredo|Ludovica Bianchi".split("|")
NAMES_CYRILLIC = "Мстислав Берёзов|Зинаида Куприна|Любомир Заяц|Орися Бондар".split("|")
SAID = "{} lives in the old town|please contact {} about it|my name is {}|ask for {} at the desk|{} wrote to us|{} wohnt in der Nähe|ich heiße {}|{} habite ici|je m'appelle {}|{} vive aquí|me llamo {}|{} trabalha aqui|chamo-me {}|{} abita qui|mi chiamo {}|Dr. {} can help".split("|")
SAID_CYRILLIC = "{} живёт рядом|меня зовут {}|{} работает здесь|{} мешкає поруч|мене звати {}|запитайте {}".split("|")


def test_names_on_no_list():
    for names, said in ((NAMES, SAID), (NAMES_CYRILLIC, SAID_CYRILLIC)):
        assert not any(n.split()[0].lower() in personal.FIRST for n in names)
        found = [("person" in kinds(t.format(n))) for n in names for t in said]
        assert sum(found) >= 0.9 * len(found)
    for text in ("Martin Luther King Road is closed", "The Mapping Group said no", "Lake Victoria Hotel wrote to us", "Nobody at Hansel Union said so"):
        assert "person" not in kinds(text), text
    assert kinds("account DE89 3704 0044 0532 0130 00") == ["id_number"] and kinds("account DE89 3704 0044 0532 0130 01") != ["id_number"]


def test_redaction_keeps_the_rest(spark):
    t = "  Mail joe [at] example [dot] com, ｔｅｌ +44 7700 900123!\nBye  "
    assert personal.redact(t) == "  Mail [EMAIL], ｔｅｌ [PHONE]!\nBye  "
    long = "x " * 20_000 + "joe@example.com"
    assert personal.redact(long) == "x " * 20_000 + "[EMAIL]"
    df = spark.createDataFrame([(1, t, 1), (2, None, 1), (3, "", 1)], "delivery_id long, text string, kind int")
    assert {r[0]: r[1] for r in personal.redacted(df, "delivery_id", "text").collect()}[2] is None
    assert {(r[0], r[1]) for r in personal.detect(df, "delivery_id", "text").collect()} == {(1, "email"), (1, "phone")}
    assert personal.detect(df.limit(0), "delivery_id", "text").count() == 0


SAMPLES = {
    "en": "nobody knows why the people were there when the bridge was closed", "de": "niemand weiß warum die Leute dort waren als die Brücke gesperrt war und nicht mehr", "fr": "personne ne sait pourquoi les gens étaient dans la rue quand le pont est fermé",
    "es": "nadie sabe por qué la gente estaba en la calle cuando el puente fue cerrado", "it": "nessuno sa perché la gente era nella strada quando il ponte è chiuso", "pt": "ninguém sabe por que as pessoas estão na rua quando a ponte não abre",
    "ru": "никто не знает почему люди были на улице когда мост был закрыт", "uk": "ніхто не знає чому люди були на вулиці коли міст був зачинений і не працював",
}


def test_languages(spark):
    texts = spark.createDataFrame([(t, 1) for t in SAMPLES.values()] * 3 + [(None, 1), ("", 1)], "text string, h int").repartition(3)
    f = languages.fit(texts, "text")
    for k, t in SAMPLES.items():
        assert [s[2] for s in f.stretches([t])[0]] == [k], k
    mixed = f.stretches([SAMPLES["en"] + ". " + SAMPLES["uk"]])[0]
    assert [s[2] for s in mixed] == ["en", "uk"] and all(0 < s[3] <= 1 for s in mixed)
    assert f.stretches([None, "", "12 34"]) == [[], [], []]
    for x, y in (("en-GB", {"en"}), ("Deutsch", {"de"}), ("und", set()), (None, set()), ("rus", {"ru"}), ("en,de", {"en", "de"})):
        assert languages.label_languages(x) == y
    rows = [(1, SAMPLES["en"], "de", 0), (2, SAMPLES["en"], "eng", 0), (3, None, "en", 0), (4, "too few words", "de", 0), (5, SAMPLES["fr"], None, 0), (6, SAMPLES["ru"] * 300, "ru", 0)]
    df = spark.createDataFrame(rows, "delivery_id long, text string, lang string, stretches int")
    got = languages.disagreements(languages.assign(df, f, "delivery_id", "text", "lang"), "delivery_id")
    assert sorted(map(tuple, got.collect())) == [(1, "en"), (5, "fr")]
    assert languages.assign(df.limit(0), f, "delivery_id", "text", "lang").count() == 0
    assert languages.fit(texts.limit(0), "text").stretches(["a word or two"]) is not None


def test_a_full_table_of_ngrams_is_widened(spark, monkeypatch):
    monkeypatch.setattr(languages, "SLOTS", 64)
    monkeypatch.setattr(languages, "_HELD", 5)
    f = languages.fit(spark.createDataFrame([(t,) for t in SAMPLES.values()] * 3, "text string"), "text")
    assert len(f.table) > 10_000
    for k, t in SAMPLES.items():
        assert [s[2] for s in f.stretches([t])[0]] == [k], k


def test_samples_are_never_empty(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE concat('text ', id) END AS text")
    assert len(samples.sample(df, "id", "text", 100)) == 100
    assert samples.sample(df, "id", "text", 100) == samples.sample(df.repartition(7), "id", "text", 100)
    assert len(samples.sample(df, "id", "text", 100_000)) == 4500
    assert len(samples.sample(df, "id", "text", 100, rows=10**12)) == 100  # as if of a table far larger
    for n in (10**6, 10**9, 10**12, 10**15):
        share = (samples.threshold(2000, n) + (1 << 63)) / (1 << 64) * n
        assert abs(share - 3000) < 10


def test_gradients_of_the_network():
    import numpy as np

    rng = np.random.default_rng(1)
    net = abuse.Network(["a"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, m, y = rng.standard_normal((3, 5, abuse.HIDDEN)), np.ones((3, 5)), np.array([1.0, 0, 1])
    m[0, 3:] = 0
    loss = lambda: float(-np.mean(y * np.log(net._forward(x, m)[0]) + (1 - y) * np.log(1 - net._forward(x, m)[0])))
    _, g, _ = net._gradients(x, m, y, np.ones(3))
    for name in ("Wf", "Ub", "A", "o", "bf"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old, e = net.p[name][at], 1e-3
        net.p[name][at] = old + e
        up = loss()
        net.p[name][at] = old - e
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-3, name


def test_abuse_on_held_out_texts(spark):
    plain = [f"the {a} team wrote to {b} about the {c} on monday" for a in ("night", "map", "harbour", "survey") for b in ("oslo", "kyiv", "porto", "turin") for c in ("bridge", "index", "notice", "sensor", "record")]
    net = abuse.fit(plain * 4)
    bad = ["what a pathetic idiot you are, delete your account", "shut up you stupid m0ron", "I will find you in Oslo and break your legs", "all foreigners are vermin and must be driven out", "free porn videos, naked girls tonight", "du bist so ein elender Idiot", "Заткнись, вонючий придурок"]
    good = ["the clinic offers breast screening for adults", "kill the process and restart the node", "any news from the harbour today", "the report counts hateful posts and explains how they were scored", "danke dir", "merci beaucoup à tous"]
    s = net.score(bad + good)
    assert (s[: len(bad)] > 0.5).mean() >= 0.85 and (s[len(bad) :] < 0.5).mean() >= 0.8
    assert net.score([None, "", "!!!"]).tolist() == [0, 0, 0]
    long = "the team wrote about the bridge " * 2000 + "shut up you stupid moron"
    assert net.score([long])[0] > 0.5  # no window is left out
    ordinary = "Could you send me the invoice before Friday?|Happy birthday, hope you have a great day|My dog loves running on the beach in the morning|the process was killed because it used too much memory|Our team lost the final but played very well.|Wir treffen uns morgen um acht vor dem Kino.|Он работает инженером на заводе.|Domani andiamo al mare con i bambini.|You can reset your password in the settings menu.|He was charged with assault after the fight outside the bar.".split("|")
    assert (net.score(ordinary) < 0.9).mean() >= 0.8
    df = spark.createDataFrame([(1, bad[0], "w", 0.0), (2, None, "w", 0.0)], "delivery_id long, text string, backend string, score double")
    got = {r[0]: (r[1], r[2]) for r in abuse.scores(df, net, "delivery_id", "text", ["backend"]).collect()}
    assert got[2] == ("w", 0.0) and got[1][1] > 0.5
    assert abuse.scores(df.limit(0), net, "delivery_id", "text").count() == 0


def test_every_window_is_scored():
    rng = __import__("random").Random(3)
    words = [f"w{k}" for k in range(40)]
    net = abuse.Network(words[:30])
    lists = [[rng.choice(words) for _ in range(n)] for n in (1, 5, 15, 16, 17, 23, 24, 25, 40, 100, 300)]
    lists += [[], lists[4], lists[9]]
    one = lambda w: max((float(net.score_words([w[k : k + abuse.WINDOW]])[0]) for k in range(max(1, len(w) - abuse.WINDOW + 1))), default=0.0)
    assert abs(net.score_words(lists) - [one(w) for w in lists]).max() < 1e-6
    phrase = [f"bad{k}" for k in range(abuse.WINDOW)]
    best = float(net.score_words([phrase])[0])
    for at in range(24):
        assert net.score_words([words[:at] + phrase + words[: 40 - at]])[0] >= best - 1e-6, at


#: Written apart from the module's phrases.
CONTENT = """The committee met on Tuesday to review the budget for the coming year. Members agreed that spending on road repairs should rise by four percent.|Preheat the oven to 180 degrees. Mix the flour, sugar and butter until crumbly, then press into the tin and bake for twenty minutes.|She walked along the shore until the light failed, thinking of the letter that had not come. The sea was quiet and the gulls had gone.|Mitochondria produce most of the chemical energy that a cell needs. Damage to them has been linked to ageing and several diseases.|Revenue for the quarter was 4.2 million, up eleven percent. Operating costs fell as two warehouses were merged.|The home side took the lead after ten minutes through a header from a corner. The visitors equalised just before half time.|Patients should take one tablet twice a day with food. Tell your doctor if you have kidney problems or are pregnant.|Der Ausschuss hat am Dienstag über den Haushalt beraten. Die Mitglieder einigten sich darauf, mehr Geld für Straßen auszugeben.|Le comité s'est réuni mardi pour examiner le budget. Les membres ont décidé d'augmenter les dépenses pour les routes.|El comité se reunió el martes para revisar el presupuesto. Los miembros acordaron gastar más en carreteras.|A comissão reuniu-se na terça-feira para rever o orçamento. Os membros decidiram gastar mais em estradas.|Il comitato si è riunito martedì per esaminare il bilancio. I membri hanno deciso di spendere di più per le strade.|Комитет собрался во вторник, чтобы обсудить бюджет. Члены решили тратить больше на дороги.|Комітет зібрався у вівторок, щоб обговорити бюджет. Члени вирішили витрачати більше на дороги.|To reset the router, hold the button for ten seconds and wait for the light to turn green. If the page does not load, check that JavaScript is enabled in your browser, as the settings page needs it.|When a server returns error 404 the browser shows that the page was not found; administrators should configure a redirect so that visitors reach the right address.|The museum opens at nine and closes at five. Tickets can be bought online or at the entrance, and children under six go free.|We hiked up the valley in heavy rain and camped beside the lake. In the morning the sky was clear and we saw two eagles.|The function returns a list of tuples. Each tuple holds the name and the size of a file in the directory.|Interest rates were left unchanged. Economists had expected a small cut after inflation slowed for the third month in a row.""".split("|")
RESIDUE = """We could not find the page you were looking for. It may have moved or been removed.|Whoops! That page is missing. Error code 404.|Internal error. Our team has been alerted, come back soon.|Your browser does not support JavaScript, or it is turned off. Switch it on to see this content.|This app works best with JavaScript enabled.|Lorem ipsum dolor sit amet, consectetuer adipiscing elit. Aenean commodo ligula eget dolor.|Dear {{first_name}}, thanks for your order #{{order_id}}. Regards, {{company}}|[Insert headline here] [Insert body here]|The site is down for scheduled maintenance. Please check back shortly.|Access to this page has been denied because we believe you are using automation tools.|Error establishing a database connection|This account has been suspended. Contact your hosting provider for more information.|Sample page. This is an example page. Replace it with your own content.|Die Seite konnte nicht gefunden werden. Zurück zur Startseite.|La page que vous cherchez est introuvable.|No se pudo encontrar la página solicitada. Inténtalo de nuevo más tarde.|Ошибка 404. Страница не существует или была удалена.|Сторінку не знайдено. Поверніться на головну.|Pagina inesistente. Torna alla home page.|Sorry, this video is not available in your country.""".split("|")


def manual():
    """Paragraphs of the language's manual, as far as it is installed."""
    topics = pytest.importorskip("pydoc_data.topics").topics
    return [p for v in topics.values() for p in v.split("\n\n") if len(p) > 120]


def test_residue(spark):
    r = residue.fit()
    prose = [f"The {a} team rebuilt {n} records of the {b} archive and signed a protocol about it. Nobody explained why the {b} bridge was closed that night." for a in ("night", "map", "harbour", "survey") for b in ("northern", "old", "public") for n in range(20)]
    bad = ["404 Not Found\nThe requested page could not be located.", "Please enable JavaScript to view this page.", "Hello {{name}}, your plan ends on {{date}}.\nAbout: {{x}}", "Lorem ipsum dolor sit amet, elit magna aliqua.", prose[0].split(". ")[0] + ".\nError 502: bad gateway\nPlease try again in 19 minutes."]
    good = [*prose[:3], " ".join(prose[:4]) + " A 404 Not Found answer means that the page moved.", None, "", "   "]
    assert [e for _, e in r.judge(bad)] == [True] * 5
    assert [e for _, e in r.judge(good)] == [False] * 7
    assert r.judge([" ".join(prose * 5)])[0][1] is False
    df = spark.createDataFrame([(1, bad[0], 1), (2, None, 1)], "doc_id long, text string, share int")
    assert {x[0]: x[2] for x in residue.judged(df, r, "doc_id", "text").collect()} == {1: True, 2: False}
    assert residue.judged(df.limit(0), r, "doc_id", "text").count() == 0


def test_residue_outside_the_tables():
    r = residue.fit()
    assert sum(e for _, e in r.judge(RESIDUE)) >= 0.9 * len(RESIDUE)
    assert sum(e for _, e in r.judge(CONTENT)) <= 0.05 * len(CONTENT)
    pages = manual()
    assert sum(e for _, e in r.judge(pages)) <= 0.05 * len(pages)


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n int, finish string")


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 7)
    monkeypatch.setattr(mixing, "PART_BITS", 1)
    rows = [(k, "word " * (5 + k % 9), "abc"[k % 3]) for k in range(300)] + [(900, "one two three " * 30, "d"), (901, None, "a"), (902, "x", None), (903, "", "a"), (5, "word", "a")]
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("d", 0.2, 3), ("e", 0.0, 1), ("f", 0.0, None)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs(spark, rows), t)
    got = m.collection().collect()
    assert [r["finish"] for r in got] == sorted(r["finish"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    most = {"a": 1, "b": 2, "d": 3}
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= most[s] for (s, _), v in by.items())
    s = {r["source"]: r for r in m.shares().collect()}
    assert s["e"]["tokens"] == 0 and s["f"]["actual_share"] == 0
    total = sum(r["n_tokens"] for r in got)
    for k, want in (("a", 0.5), ("b", 0.3), ("d", 0.2)):
        assert abs(s[k]["actual_share"] - want) < 100 / total + 0.01
        assert s[k]["tokens"] == sum(r["n_tokens"] for r in got if r["source"] == k)
    half = mixing.Mixture(docs(spark, rows), t, budget=m.budget / 2)
    assert half.picked().agg(F.sum("n")).first()[0] <= m.budget / 2 + 1
    assert mixing.Mixture(docs(spark, []), t).collection().count() == 0
    assert mixing.Mixture(docs(spark, rows), t.limit(0)).collection().count() == 0
