"""Template residue, filler, error pages and notices that scripts are needed, in place of text for a reader.

Texts are cut into messages: lines and sentences. In each, addresses, dates, numbers and ids are masked and marks dropped; what is left is
hashed, and exact hashes of all of them are counted over documents and sources, pre-aggregated before the shuffle. Rules class the distinct ones:
a message that is as a whole an error, a notice or filler is residue wherever it stands; one that only goes with such messages is if it recurs
widely; one of unknown wording, in any language, is if in documents of several sources it is most of the text or, as the text's whole, all of it.
Sentences that quote or mention such things are longer than the rules allow, and each is unlike the next. Placeholders are marks of
template languages left in a text, and filler also is what repeats a word or is made of filler's words.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartalog.llm.tokenizer import spread
from cartalog.session import broadcast_if_small, cut

#: A message recurs widely from so many documents and sources on.
WIDE_DOCS, WIDE_SOURCES = 3, 2
#: A message whose wording no rule knows is a page of its own if it is so much of the text of so many documents and sources, and of so much of those it is in.
PAGE_TEXT, PAGE_DOCS, PAGE_SOURCES, PAGE_SHARE = 0.6, 5, 3, 0.5
#: Of so many words, as messages have and texts for readers seldom, it is from fewer documents on. One has two words at least: numbers, names and blanks alone are none.
SHORT_WORDS, SHORT_DOCS = (4, 25), 4
#: What a message's wording tells: residue wherever it stands, residue where it recurs widely, nothing.
RESIDUE, GOES_ALONG, UNKNOWN = 2, 1, 0

#: Names of mark-up that is no placeholder though it is written in capitals between angle brackets.
MARKUP = "A|ABBR|ADDRESS|ARTICLE|B|BIG|BLOCKQUOTE|BODY|BR|BUTTON|CENTER|CODE|DD|DIV|DL|DT|EM|FONT|FOOTER|FORM|H[1-6]|HEAD|HEADER|HR|HTML|I|IFRAME|IMG|INPUT|LABEL|LI|LINK|MAIN|META|NAV|NOSCRIPT|OL|OPTION|P|PRE|SCRIPT|SECTION|SELECT|SMALL|SPAN|STRONG|STYLE|SUB|SUP|TABLE|TBODY|TD|TEXTAREA|TFOOT|TH|THEAD|TITLE|TR|TT|U|UL"
#: Marks of template languages, and notes to whoever should have filled a template in.
PLACEHOLDERS = (
    r"\{\{[^{}]++\}\}",
    r"\{%[^%]++%\}",
    r"<%[=-]?[^%]++%>",
    r"[$#]\{[A-Za-z_][^{}]*+\}",
    r"%\([A-Za-z_]\w*\)[sdifr]",
    r"(?<![\w%])%[A-Z][A-Z0-9_]{2,}+%",
    r"\[\[[^\[\]]++\]\]",
    r"\[(?i:your|insert|enter|add|put|type|hier|bitte|ihr|ihre|name|votre|vos|insérer|insérez|entrez|nom|titre|text|texte|inserte|su)\b(?=[^\[\]]*+\])[^\[\]]*?(?i:here|hier|ici|text|texte|name|namen|nom|title|titel|titre|einfügen|eintragen|aquí|date|datum|address|adresse|description)",
    r"\[[A-Z][A-Z_]+(?: [A-Z_]+)+\]",
    r"(?<!\w)__[A-Z][A-Z0-9_]*[A-Z0-9]__(?!\w)",
    r"@@[A-Za-z][A-Za-z0-9_]*@@",
    r"\$\$[A-Za-z][A-Za-z0-9_]*\$\$",
    r"<<[A-Za-z_][A-Za-z0-9_ ]*+>>",
    rf"<(?!(?:{MARKUP})>)[A-Z][A-Z_]{{2,}}+>",
    r"(?<![\w{$#])\{[0-9]{1,2}\}(?!\})",
    r"(?<![\w{$#])\{[a-z]+(?:[_.][a-z0-9]+)+\}(?!\})",
    r"(?<!\w)(?:TODO|FIXME|TBD):",
    r"(?<!\w)(?:XX:XX|XX\.XX\.(?:XX)?XX|XX/XX/(?:XX)?XX)(?!\w)",
    r"(?i)\((?:to be filled in|wird noch ausgefüllt|noch auszufüllen|à compléter|à remplir)\)",
)
#: Words that filler is made of and prose in the corpus' languages is not.
FILLER = (
    "lorem ipsum dolor amet consectetur consectetuer adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua veniam nostrud ullamco laboris "
    "aliquip commodo consequat irure reprehenderit voluptate velit cillum fugiat pariatur excepteur occaecat cupidatat proident deserunt mollit laborum "
    "nullam semper autem cursus lacus vestibulum pellentesque mauris vivamus praesent curabitur phasellus fusce donec etiam aenean quisque suspendisse sit"
).split()
#: What fingers write on a keyboard to fill a field.
MASHED = "asdf asd asdfg asdfgh asdfjkl sdfg dfgh fghj ghjk hjkl jkl jklö qwer qwert qwerty qwertz qwertzu azerty wert yxcv yxcvb zxcv zxcvb blabla bla foo bar foobar baz test".split()

_SCRIPT = r"(?:java ?scripts?|scripts?|scripting|les scripts|skripte?)"
_CODE = "(?:not found|forbidden|bad gateway|bad request|unauthorized|internal server error|service (?:temporarily )?unavailable|gateway time ?out|too many requests|moved permanently|method not allowed|gone)"
#: Messages that are, as a whole, residue. They are read without marks but : and #; numbers, ids and addresses are 0.
WHOLE = (
    # scripts needed
    rf"(?:(?:please|you (?:must|need to|have to)|kindly) )?(?:enable|activate|turn on|allow|switch on) {_SCRIPT}\b.*",
    rf"{_SCRIPT}(?: (?:and|und|et) cookies)? (?:is|are|must|should|has|have|needs?|ist|sind|muss|müssen|est|sont|doit|doivent)\b.*?(?:disabled|required|enabled|allowed|needed|turned off|switched off|deaktiviert|aktiviert|erforderlich|eingeschaltet|erlaubt|désactivée?s?|activée?s?|nécessaires?|requis|autorisée?s?)\b.*",
    rf"(?:this|the|diese|ce|cette|our) (?:site|page|website|web site|app|application|map|seite|karte|webseite)\b.*? (?:needs?|requires?|benötigt|braucht|nécessite|requiert) {_SCRIPT}\b.*",
    rf"(?:your|ihr|votre) (?:browser|navigateur)\b.*?(?:turned off|disabled|deaktiviert|désactivé|blocks?|does not support {_SCRIPT}).*",
    r"(?:we are )?checking (?:if )?your browser\b.*",
    rf"(?:bitte )?(?:aktivieren|erlauben|schalten) sie {_SCRIPT}\b.*",
    rf"(?:vous devez |veuillez |merci d'|il faut )?(?:activer|activez|autoriser|autorisez) {_SCRIPT}\b.*",
    rf"(?:por favor )?(?:active|activa|habilite|habilita|abilita|abilitare|attivare) {_SCRIPT}\b.*",
    rf"noscript:? ?.*|turn on {_SCRIPT}\b.*",
    # errors
    r"(?:http |server )?(?:error|fehler|erreur|errore) (?:code )?0 ?:? ?.*",
    rf"(?:http |error )?0 ?:? {_CODE}\b.*|{_CODE}",
    r"(?:internal server error|interner serverfehler|erreur interne du serveur)\b.*|(?:page|file|seite|datei|site) (?:not found|nicht gefunden|introuvable|non trouvée)\b.*|la page\b.*?(?:est introuvable|n'existe pas)\b.*",
    r"(?:access|permission) denied\b(?: request id .+)?|zugriff verweigert|accès (?:refusé|interdit)|request id \S+",
    r"traceback most recent call last:?|file \S+ line 0(?: in \w+)?|stack trace:?|#0 .+|at \S+\(\S+:0\)",
    r"(?:fatal |parse |syntax |runtime |unhandled |uncaught )(?:error|exception)\b.*|uncaught exception\b.*|(?:key|type|value|name|index|attribute|import|runtime|null ?pointer|io|sql)(?:error|exception)\b:?.*",
    r"(?:warning|notice|error|fatal): ?(?:could not|cannot|can't|failed|undefined|mysql|include|division|call to|unable)\b.*|(?:could not|cannot|failed to|unable to) connect to\b.*",
    r"(?:the )?connection to .+? (?:timed out|was refused|was reset|failed)|(?:connection|request|gateway) (?:timed out|time ?out|refused|reset)\b.*",
    r"(?:your|ihre|votre) (?:session|sitzung) (?:has |ist |a )?(?:expired|timed out|abgelaufen|expiré)\b.*|too many requests|your (?:ip )?address (?:has been|was|is) (?:limited|blocked|banned)\b.*",
    r"(?:an?|une|ein) (?:unexpected |unknown |internal |interner |unerwarteter |unbekannter )?(?:error|fehler|erreur)(?: interne| inattendue)? (?:has occurred|occurred|ist aufgetreten|est survenue|s'est produite)\b.*",
    r"(?:erreur|fehler|error)(?: interne)? 0 : une? erreur\b.*",
    r"the (?:\w+ )?page (?:that )?you (?:asked for|requested|are looking for|were looking for)\b.*|this page (?:has moved|was removed|has been (?:moved|removed|deleted)|does not exist|is no longer)\b.*|diese seite (?:existiert nicht|wurde (?:verschoben|gelöscht|entfernt))\b.*|cette page (?:n'existe|a été)\b.*",
    r"(?:the )?\w+ (?:service )?(?:is )?(?:temporarily |currently )?unavailable|the \w+ could not be (?:rendered|shown|loaded|displayed)\b.*",
    # filler
    r"(?:sample|dummy|placeholder|filler|example) (?:text|description|content|paragraph|title)\b.*|(?:this is )?(?:just )?(?:some |a )?(?:dummy|filler|placeholder) text\b.*",
    r"your (?:headline|subheading|text|title|content|description|slogan|name) (?:goes|comes) here|(?:headline|title|text|content) goes here",
    r"hier (?:steht|kommt|folgt) (?:später |bald |demnächst )?(?:ihr|der|ein) (?:text|titel|inhalt)\b.*|(?:platzhaltertext|platzhalter|blindtext|mustertext|fülltext|beispieltext)\b.*",
    r"(?:texte|contenu|paragraphe) (?:de remplissage|fictif|d'exemple|factice)\b.*|(?:votre|insérez votre) (?:texte|titre) ici",
    r"replace this (?:paragraph|text|sentence|line|title)\b.*|(?:insert|enter|add|put|type) (?:your )?(?:text|content|description|title|name) here|lorem ipsum\b.*",
)
#: Messages that go with residue, and are it where they recur widely.
BESIDE = (
    r"(?:please )?(?:try|sign in|log in|reload|refresh|come back|check the address)\b.*?(?:again|later|page|minutes|continue)\b.*",
    r"(?:bitte )?(?:versuchen sie es|laden sie|melden sie sich)\b.*|zurück zur startseite|bitte ersetzen",
    r"(?:veuillez |merci de )?(?:réessayer|réessayez|recharger|rechargez)\b.*|retour à l'accueil",
    r"the \w+ (?:cannot|can not|can't) be (?:shown|displayed|loaded)\b.*|(?:coming soon|under construction|im aufbau|en construction)",
)

_WEB = r"(?:https?://|www\.)\S+|(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+"
#: Numbers, dates, times and numeric addresses, and ids of letters and digits.
_NUMBER = r"\b(?=[a-f]*+[0-9])[0-9a-f]{6,}+(?:-[0-9a-f]{4,})*+\b|[0-9]++(?:[.:,/-][0-9]++)*+(?:t[0-9:.]++z?)?"
#: Stand for the end of a sentence and for a word's hyphen at the end of a line.
_SENTENCE, _HYPHEN = "\x01", "\x02"


def _one_of(words: Iterable[str]) -> str:
    """A pattern for any of the words that looks at each letter once."""
    tree: dict[str, dict] = {}
    for word in words:
        node = tree
        for ch in f"{word}\0":
            node = node.setdefault(ch, {})

    def written(node: dict[str, dict]) -> str:
        parts = [ch + written(below) for ch, below in sorted(node.items()) if ch != "\0"]
        both = parts[0] if len(parts) == 1 and "\0" not in node else f"(?:{'|'.join(parts)})"
        return "" if not parts else both + ("?" if "\0" in node else "")

    return written(tree)


def readable(rows: DataFrame) -> DataFrame:
    """rows with a text without invisible characters and entities of mark-up; runs of blanks are one."""
    rows = rows.withColumn("text", F.regexp_replace("text", r"[\p{Cf}\x01\x02͏︀-️]", ""))
    decoded = F.col("text")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#123;", "{"), ("&#125;", "}"), ("&nbsp;", " "), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(entity), F.lit(sign))
    return rows.withColumn("text", F.regexp_replace(F.when(F.contains("text", F.lit("&")), decoded).otherwise(F.col("text")), r"[\p{Zs}\t]+", " "))


def masked(rows: DataFrame) -> DataFrame:
    """rows with their readable text in lower case without mark-up and marks, addresses, dates, ids and numbers masked; ends of lines and sentences stay."""
    rows = rows.withColumn("text", F.regexp_replace(F.lower("text"), "</?[a-z!][^<>%]*+>", "\n"))
    web = F.contains("text", F.lit("@")) | F.contains("text", F.lit("://")) | F.contains("text", F.lit("www."))
    text = F.regexp_replace(F.when(web, F.regexp_replace("text", _WEB, " 0 ")).otherwise(F.col("text")), _NUMBER, "0")
    for pattern, by in (
        (r"\s*[\r\n]+[> |]*+\s*", "\n"),
        (r"(?<=[.!?…])\s+", _SENTENCE),
        (r"(?<=\w)-\n", _HYPHEN),
        (r"[^\p{L}\p{M}0-9:#'’<>%(/.\n\x01\x02]+|[(.](?=[\s\x01]|$)|(?<=[\s\x01])[('’]|^[('’]|['’](?=[\s\x01]|$)", " "),
        (r"[( ]+", " "),
        (r" ?([\n\x01\x02]) ?", "$1"),
    ):
        text = F.regexp_replace(text, pattern, by)
    return rows.withColumn("text", text)


def _bare(text: Column) -> Column:
    """The lines and sentences of a masked text."""
    return F.split(text, "[\n\x01\x02]+")


def _joined(text: Column) -> Column:
    """The sentences of a masked text with its wrapped lines joined."""
    return F.split(F.regexp_replace(F.replace(text, F.lit(_HYPHEN), F.lit("")), "\n+", " "), "\x01+")


def has_placeholder(text: Column) -> Column:
    """The first test only spares texts without any of the signs that placeholders are made of."""
    return text.rlike(r"[{}%$@\[<_(]|TODO:|FIXME:|TBD:|XX") & text.rlike("|".join(f"(?:{p})" for p in PLACEHOLDERS))


def is_filler(text: Column) -> Column:
    """A word five times in a row, keys mashed three times, or eight words in a row of which one in three at least is filler's."""
    lower = F.lower(text)
    mashed = rf"(?:{_one_of(MASHED)}|xxx++)(?!\w)"
    run = rf"(?:\b{_one_of(FILLER)}\b\W+(?:\w+\W+){{0,2}}){{7}}"
    return lower.rlike(r"(?<!\w)(\p{L}{2,}+)(?:[\s,.]+\1(?!\w)){4}") | lower.rlike(rf"(?<!\w){mashed}(?:[\s,.]+{mashed}){{2}}") | lower.rlike(run)


def _rule(patterns: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"


def residue(docs: DataFrame, doc: str, text: str, source: str) -> DataFrame:
    """(doc): the documents that are residue, wholly or in part, each once.

    Null, empty and blank texts, null ids, and texts that only speak of such things are none; a null source counts as one of its own; texts are
    taken whole, however long; repeated rows change nothing but the counts; an empty table gives an empty one. Other columns play no part.
    """
    rows = spread(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(source), F.lit(""))).alias("source")))
    rows = readable(rows.where("doc is not null and text is not null"))
    # One pass over the texts: what is kept of them are the hashes of all messages and of the whole as one, with what their wording tells, as shipping
    # every message's text would cost more; a placeholder or filler, which marks or repetition tell, is a message without hash.
    made = masked(rows.withColumn("direct", has_placeholder(F.col("text")) | is_filler(F.col("text"))))
    wrapped = F.when(F.contains("text", F.lit("\n")) | F.contains("text", F.lit(_HYPHEN)), _joined(F.col("text"))).otherwise(F.array().cast("array<string>"))
    # What goes through an array of one is made once, not once for each use.
    made = made.select("doc", "source", "direct", F.explode(F.array(F.struct(_bare(F.col("text")).alias("bare"), wrapped.alias("joined")))).alias("l"))
    whole = F.trim(F.concat_ws(" ", F.array_distinct(F.when(F.size("l.joined") > 0, F.col("l.joined")).otherwise(F.col("l.bare")))))
    made = made.select("doc", "source", "direct", F.transform(F.concat("l.bare", "l.joined"), lambda m: F.trim(m)).alias("parts"), F.explode(F.array(whole)).alias("whole"))
    kept = F.filter(F.array_distinct(F.concat("parts", F.array("whole"))), lambda m: m != "")
    said = made.select("doc", "source", "direct", F.length("whole").alias("size"), F.explode_outer(kept).alias("message"))
    wording = F.when(F.col("message").rlike(_rule(WHOLE)), RESIDUE).when(F.col("message").rlike(_rule(BESIDE)), GOES_ALONG).otherwise(UNKNOWN)
    words = F.regexp_count("message", F.lit(r"\p{L}{2,}"))
    page = F.when(F.length("message") < PAGE_TEXT * F.col("size"), 0).when(words < 2, 0).when(words.between(*SHORT_WORDS), 2).otherwise(1)
    said = said.select("doc", "source", "direct", F.when(F.col("message").isNotNull(), F.xxhash64("message")).alias("hash"), wording.cast("byte").alias("wording"), page.cast("byte").alias("page"))
    said = cut(said)
    direct_docs = said.where("direct").select("doc")
    by_source = said.where("hash is not null").groupBy("hash", "wording", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("page") > 0).alias("pages"), F.max("page").alias("page"))
    counted = by_source.groupBy("hash", "wording").agg(
        F.sum("n").alias("docs"), F.count(F.lit(1)).alias("sources"), F.sum("pages").alias("pages"), F.count_if(F.col("pages") > 0).alias("page_sources"), F.max("page").alias("page")
    )
    wide = (F.col("docs") >= WIDE_DOCS) & (F.col("sources") >= WIDE_SOURCES)
    many = ((F.col("pages") >= PAGE_DOCS) & (F.col("page_sources") >= PAGE_SOURCES)) | ((F.col("page") == 2) & (F.col("pages") >= SHORT_DOCS) & (F.col("page_sources") >= PAGE_SOURCES))
    classed = counted.where((F.col("wording") == RESIDUE) | (wide & (F.col("wording") == GOES_ALONG)) | (many & (F.col("pages") >= PAGE_SHARE * F.col("docs"))))
    classed = cut(classed.select("hash"))
    found = said.select("doc", "hash").join(broadcast_if_small(classed), "hash").select("doc")
    return direct_docs.unionByName(found).distinct()
