import pytest

from codewell.llm.names import channel, edits, link_names, parse, skeleton

SAME = [
    ("Jthn Bripilgurho", "John Charles Bripilgurho"), ("BRIPILGURHO, Jack", "John Charles Bripilgurho"), ("A.S. Mahegurtrir", "Anthony Susannah Mahegurtrir"),
    ("Henry Burjubrihal, Valeria", "Valeria Henry Burjubrihal"), ("Grunlisjenlel Bros", "Grunlisjenlel Brothers Band"), ("coro d. Hunmalcomal", "Coro de Hunmalcomal"),
    ("C. de Begrintardu", "Coro de Begrintardu"), ("Los Kanlerpeszun del N.", "Los Kanlerpeszun del Norte"), ("Orquestra Drartraroskan", "Orquesta Drartraroskan"),
    ("y. cetarposbis", "Yolanda Cetarposbis"), ("The. Kalventromu", "Theodore Kalventromu"), ("Th. Zekenkecir Meadows", "The Zekenkecir Meadows"),
    ("Dissefasbu Comets", "The Dissefasbu Comets"), ('Dolores "Lola" Kontirdroho', "Dolores Kontirdroho"), ("Luis_Helrilinpas", "Luis Helrilinpas"),
    ("Orquesta Zugradrou", "Orquesta Zugradromu"), ("Los-Temuhubis del Norte", "Los Temunhubis del Norte"), ("D. Nidolpunjil", "Dolores Nidolpunjil"),
]
OTHER = [
    ("Katherine Molbanmurbro", "Elizabeth Molbanmurbro"), ("Orquesta Pundagrebri", "Coro de Pundagrebri"), ("B. Dislunetrir", "Jacinta Dislunetrir"),
    ("The Calelhelgel Engines", "Coro de Calelhelgel"), ("Molbanmurbro", "Elizabeth Molbanmurbro"), ("José Drajuberver", "José Femuverbro"), ("Robert X", "Roberto X"),
    ("Damián Paljessegi", "Drungelgronur, Damián P."), ("Marisol Neszoguzi", "Jundartabre, Marisol N."), ("M Nurdrisbralge", "Marisol Nadia Jundartabre"),
]


@pytest.mark.parametrize("pair", SAME)
def test_channel_explains(pair):
    assert channel(*pair) is not None


@pytest.mark.parametrize("pair", OTHER)
def test_channel_refuses(pair):
    assert channel(*pair) is None


def test_parts():
    assert edits("abcd", "abdc") == 1 and edits("abcd", "xyzw", 2) == 3 and edits("", "a") == 1
    assert skeleton("drubrilphoosz") == skeleton("drubrilfus") == "drubrilfus"
    assert parse("")[1] == () and parse("...")[1] == ()


def test_links(spark):
    rows = [("Ana Zolmolgodro", 5), (" Ana Zolmolgodro", 1), ("Ana Zolmolgodro", 4), ("A. Zolmolgodro", 2), ("Ana Zolmolgodra", 2), ("Ian Zolmolgodro", 9), (None, 1), ("", 1), ("  ", 1), ("??", 3), ("x" * 5000, 1)]
    df = spark.createDataFrame(rows, "name string, w long").selectExpr("name", "w", "1 as canonical", "'q' as key")
    got = {r.name: (r.canonical, r.n) for r in link_names(df, "name", "w").collect()}
    assert got["Ana Zolmolgodro"] == ("Ana Zolmolgodro", 10)
    assert got["A. Zolmolgodro"][0] == got["Ana Zolmolgodra"][0] == "Ana Zolmolgodro"
    assert got["Ian Zolmolgodro"][0] == "Ian Zolmolgodro" and got["??"] == ("??", 3) and len(got) == 6
    assert link_names(df.limit(0), "name", "w").count() == 0


def test_shared_tokens_are_split_not_dropped(spark):
    import random

    rng = random.Random(4)
    given = ["bamabo", *("".join(rng.choice("acdefgijklmnoprstu") for _ in range(7)) for _ in range(60))]
    rows = [(f"{g.title()} Garciano",) for g in given] + [("Bamabo Garciamo",), ("B. Garciano",)]
    got = {r.name: r.canonical for r in link_names(spark.createDataFrame(rows, "name string")).collect()}
    assert got["Bamabo Garciano"] == "Bamabo Garciamo"  # a tie goes to the smaller string
    assert got["B. Garciano"] == "Bamabo Garciamo" and len(set(got.values())) == 61


def _linked(spark, *more, surname="Garciano", many=60):
    """Canonical forms where the surname stands in many spellings."""
    import random

    rng = random.Random(4)
    rows = [(f"{''.join(rng.choice('acdfgijklnostu') for _ in range(7)).title()} {surname}",) for _ in range(many)] + [(m,) for m in more]
    return {r.name: r.canonical for r in link_names(spark.createDataFrame(rows, "name string"), "name").collect()}


def test_frequent_surname_is_core_beside_an_initial(spark):
    got = _linked(spark, "Xyz Garciano", "X. Garciano", "Hiroshi Garciano", "H. Garciano")
    assert got["X. Garciano"] == "Xyz Garciano" and got["H. Garciano"] == "Hiroshi Garciano" and len(set(got.values())) == 62


def test_nicknames_of_other_initials_meet_at_a_frequent_surname(spark):
    pairs = [("Bob", "Robert"), ("Pepe", "Jose"), ("Lalo", "Eduardo"), ("Peggy", "Margaret")]
    got = _linked(spark, *(f"{n} Martinez" for p in pairs for n in p), "Quartet Martinez", "Q. Martinez", surname="Martinez")
    assert all(got[f"{a} Martinez"] == got[f"{b} Martinez"] == f"{b} Martinez" for a, b in pairs)
    assert got["Q. Martinez"] == "Quartet Martinez" and len(set(got.values())) == 65


def test_names_of_short_tokens_only(spark):
    rows = ["Ana Paz", "ANA PAZ", "Aná Paz", "A. Paz", "Li Na", "LI NA", "Bob Roy", "Fob Roy", "ÁBC", "abc", "Los Bros", "LOS BROS", "??", "Al Ey"]
    got = {r.name: r.canonical for r in link_names(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    assert len({got[n] for n in rows[:4]}) == 1 and all(got[a] == got[b] for a, b in (rows[4:6], rows[6:8], rows[8:10], rows[10:12]))
    assert len(set(got.values())) == 7


def test_hot_short_spelling_and_rare_full_one(spark):
    rows = [("P. Hotzmann", 300_000), ("Peter Hotzmann", 3), ("Paul Hotzmann", 2), ("Q. Hotzmann", 300_000)]
    got = {r.name: (r.canonical, r.log_posterior) for r in link_names(spark.createDataFrame(rows, "name string, w long"), "name", "w").collect()}
    assert got["P. Hotzmann"][0] == "Peter Hotzmann" and got["P. Hotzmann"][1] > 0
    assert len({c for c, _ in got.values()}) == 3


def test_links_do_not_depend_on_how_frequent_a_surname_is(spark, monkeypatch):
    import codewell.llm.names as names

    pairs = [("Bill", "William"), ("Bob", "Robert"), ("Pepe", "Jose"), ("Paco", "Francisco"), ("Lexie", "Alexandra")]
    few, many = (_linked(spark, *(f"{n} Garciano" for p in pairs for n in p), many=k) for k in (3, 400))
    assert all(got[f"{a} Garciano"] == got[f"{b} Garciano"] == f"{b} Garciano" for a, b in pairs for got in (few, many))
    monkeypatch.setattr(names, "BLOCK", 3)  # blocks in parts
    assert _linked(spark, *(f"{n} Garciano" for p in pairs for n in p), many=400) == many


def test_blocks_of_a_frequent_surname_give_few_candidates():
    from collections import Counter

    import random

    rng = random.Random(1)
    people = {f"{''.join(rng.choice('abcdefghijklmnoprstu') for _ in range(6))} garciano" for _ in range(2000)}
    sizes = Counter(k for p in people for k, whole in names_keys(p) if whole)
    assert sum(n * n for n in sizes.values() if n > 1) < 10 * len(people) * 20


def names_keys(name):
    from codewell.llm.names import keys_of

    return keys_of(name).items()
