from cartalog.llm.residue import residue

CASES = [
    "Stop: {{stop_name}}", "Line %LINE_NO% leaves", "Notice for [Your text here]", "From $$STREET$$ on", "at <AGENCY> today", "in {0} minutes", "{stop_lat}, {stop_lon}", "Dear {{" + "a very long name of a field " * 20 + "}}", "[Your " + "long " * 60 + "address here]", "TODO: describe this stop", "XX:XX (time to be filled in)", "near <%= departure_time %> now",
    "to <<to_stop>> and", "on @@DATE@@", "in __CITY__ centre", "${agency_name} says", "{% block notice %}", "%(district)s", "#{platform}", "[[place]]", "[INSERT STOP NAME HERE]", "a {{ route.short_\nname }} b", "x &lt;AGENCY&gt; y",
    "404 Not Found\nThe timetable page you asked for does not exist on this server.", "<html><body><h1>502 Bad Gateway</h1></body></html>", "Some news.\nWarning: could not connect to database 'stops' (timeout after 561 ms)", "Traceback (most recent call last):\n  File \"board.x\", line 273, in render\nKeyError: 'stop_name'",
    "Erreur 500 : une erreur interne est survenue. Veuillez réessayer plus tard.", "Seite nicht gefunden (Fehler 404). Zurück zur Startseite.", "Access denied. Request id b3bf3b27.", "Please enable JavaScript to view " + "all the departures of the lines and " * 20 + "nothing else.", "Too many requests. Your address has been limited for 300 seconds.",
    "Stop A\nMenu\nSearch\nPlease enable JavaScript to view live departures.", "VOUS DEVEZ ACTIVER JAVASCRIPT POUR CONSULTER CETTE PAGE.", "Bitte aktivieren Sie JavaScript, um den Fahrplan anzuzeigen.", "noscript: turn on scripting and reload this board", "<noscript>This site needs scripts to work. Your browser has them turned off.</noscript>",
    "Please enable Java​Script to view\n> live departures.", "text text text text text text text text", "A walk. asdf asdf asdf qwer qwer asdf", "Magna viarum elit portu sit elit haltor autem sit nullam urbes elit magna sit ipsum", "Lorem ipsum dolor sit amet.", "Hier steht später Ihr Text. Bitte ersetzen.", "Texte de remplissage, à remplacer avant publication.",
]
FINE = [
    "Bus 404 was not found at X on Friday; the gang says it broke down.", "The plan for X has 500 seats, 230 of them not available before Thursday.", "The sign at X reads 'Access denied' in red, says the dispatcher; the gate opens again on Monday.", "The library in X holds a JavaScript evening on Friday at 19:50.",
    "An error in the printed timetable of X was corrected on Tuesday.", "Mappers in X write names between curly brackets such as {name} in the export pattern.", "At X the template for cutting kerb stones lies with the ferry master.", "The page count of the leaflet is 88; two conductors found no placeholder left.", "House number 503 in X is missing on the map.",
    "<p>Line 4 leaves</p>\n<LI>at noon</LI>", "Il est sit et ut in ex ad.", "50% of the 20% left", "[1] and [2] (see above)", "The session of the council has expired members on its list, says a volunteer.", None, "", "  ", "word " * 3, "no no no no", "Kluvumatodo: gate", "a" * 300_000, "{{" * 50_000, "[your " * 30_000, " \n" * 100_000, "a@" * 50_000, "(" * 100_000,
]


def test_cases(spark):
    rows = [(k, t, "abc"[k % 3]) for k, t in enumerate(CASES)] + [(1000 + k, t, None if k % 2 else "d") for k, t in enumerate(FINE)]
    df = spark.createDataFrame([*rows, rows[0], (None, CASES[0], "a")], "doc_id int, text string, source string")
    got = {r["doc"] for r in residue(df, "doc_id", "text", "source").collect()}
    assert {CASES[k] for k in set(range(len(CASES))) - got} == set()
    assert {FINE[k - 1000] for k in got if k >= 1000} == set()
    assert residue(df.limit(0), "doc_id", "text", "source").count() == 0


def test_messages_beside_count_where_they_recur(spark):
    text = "Please try again in a few minutes."
    once = spark.createDataFrame([(1, text, "a")], "doc_id int, text string, source string")
    often = spark.createDataFrame([(k, text, "ab"[k % 2]) for k in range(4)], "doc_id int, text string, source string")
    assert residue(once, "doc_id", "text", "source").count() == 0
    assert residue(often, "doc_id", "text", "source").count() == 4


def test_pages_in_languages_without_rules(spark):
    dutch, polish = "Pagina niet gevonden. Het adres {0} bestaat niet op deze dienst.", "<html><body><h1>Nie znaleziono strony</h1>\nWróć do strony głównej i wybierz przystanek.</body></html>"
    rows = [(k, dutch.format(k), "abc"[k % 3]) for k in range(6)] + [(10 + k, polish, "abc"[k % 3]) for k in range(6)]
    rows += [(20, "De halte ligt bij de oude molen aan de rivier.\nHet adres 7 bestaat niet op deze dienst.", "a"), (21, "The bench stands beside the old chapel.\nNie znaleziono strony Wróć do strony głównej i wybierz przystanek.", "b")]
    # What recurs as a small part of texts, in one source, or as numbers only is none.
    walks = ("river", "harbour", "market", "chapel", "depot", "quarry")
    rows += [(30 + k, f"Lees eerst dit bericht. The walk along the {w} takes {k} minutes past the gate and the sign for the {w} steps.", "abc"[k % 3]) for k, w in enumerate(walks)]
    rows += [(40 + k, "Halte gesloten wegens onderhoud.", "a") for k in range(6)] + [(50 + k, str(k), "abc"[k % 3]) for k in range(6)] + [(60, dutch.replace("Pagina", "Bladzijde"), None)]
    got = {r["doc"] for r in residue(spark.createDataFrame(rows, "doc_id int, text string, source string"), "doc_id", "text", "source").collect()}
    assert got == {*range(6), *range(10, 16), 20, 21, 60}


def test_short_pages_from_four_documents_on(spark):
    """Messages of no listed language, one document a source."""
    pages = ["Nie znaleziono strony o podanym adresie {0}.", "Sivua ei löytynyt palvelimelta (virhe {0}).", "A keresett oldal nem található a kiszolgálón, kód {0}."]
    rows = [(10 * p + k, page.format(k), "abcd"[k]) for p, page in enumerate(pages) for k in range(4)]
    # A text for readers, copied as often, has more words; a label has fewer.
    walk = "Nach Osten führt der Weg am Bach entlang zur alten Mühle und weiter über die Wiesen bis an den Rand des Dorfes, wo die Linie ihre letzte Haltestelle hat und wendet."
    rows += [(100 + k, walk, "abcd"[k]) for k in range(4)] + [(110 + k, "Alte Mühle", "abcd"[k]) for k in range(4)] + [(120 + k, pages[0].format(k).replace("strony", "stron"), "a") for k in range(3)]
    got = {r["doc"] for r in residue(spark.createDataFrame(rows, "doc_id int, text string, source string"), "doc_id", "text", "source").collect()}
    assert got == {10 * p + k for p in range(3) for k in range(4)}
