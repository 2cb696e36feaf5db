"""Realistic values picked from a keyed seed: the same value and type give the same fake in any table, on any executor.

The seed depends on the lowered value and the key alone, so no dictionary has to be kept or shuffled. Names and places are this engine's own lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.crypto import hmac_hex, long_of
from lamina.model import RuleError, Secrets, SemanticType

# Word lists by locale.
FIRST = {
    "fr": [
        "Adèle", "Agathe", "Alban", "Alix", "Amaury", "Anaïs", "Antoine", "Armand", "Aurore", "Axel", "Bastien", "Blanche", "Cécile", "Célia",
        "Clément", "Corentin", "Damien", "Diane", "Edgar", "Éloïse", "Émile", "Esteban", "Fanny", "Félix", "Florian", "Gabin", "Garance", "Gaspard",
        "Hélène", "Hortense", "Inès", "Jeanne", "Joël", "Jules", "Léonie", "Lila", "Loïc", "Lucien", "Maëlle", "Marius", "Mathis", "Mélanie",
        "Nathan", "Noé", "Octave", "Odile", "Pauline", "Quentin", "Rémi", "Romane", "Sacha", "Solène", "Théo", "Tristan", "Valentin", "Victoire",
        "Yann", "Zoé",
    ],
    "en": [
        "Abigail", "Adam", "Alice", "Amber", "Andrew", "Arthur", "Beth", "Bruce", "Caleb", "Carla", "Chester", "Clara", "Daisy", "Dennis", "Derek",
        "Edith", "Elliot", "Emma", "Ethan", "Faith", "Felix", "Fiona", "Frank", "George", "Grace", "Hazel", "Henry", "Holly", "Isaac", "Ivy", "Jack",
        "Jasper", "June", "Karen", "Keith", "Laura", "Leo", "Lily", "Logan", "Mabel", "Martin", "Megan", "Miles", "Nancy", "Neil", "Olive", "Oscar",
        "Paige", "Peter", "Quinn", "Rachel", "Ralph", "Rose", "Ruth", "Simon", "Stella", "Thomas", "Tracy", "Vera", "Walter", "Wendy",
    ],
}
LAST = {
    "fr": [
        "Albert", "Barbier", "Baudry", "Bellanger", "Berger", "Blondel", "Bonnet", "Boucher", "Carpentier", "Chauvet", "Clerc", "Colas", "Cordier",
        "Courtois", "Delorme", "Descamps", "Dumas", "Fabre", "Ferrand", "Fleury", "Gaillard", "Gilbert", "Giraud", "Grenier", "Guichard", "Hamel",
        "Humbert", "Imbert", "Jacquet", "Joly", "Lacombe", "Lambert", "Langlois", "Leblanc", "Lefort", "Lemoine", "Maillard", "Marchal", "Mercier",
        "Millet", "Monnier", "Noël", "Olivier", "Parent", "Pelletier", "Perrot", "Poirier", "Prévot", "Renault", "Rivière", "Rolland", "Royer",
        "Salmon", "Tessier", "Tixier", "Vallet", "Vasseur", "Verdier",
    ],
    "en": [
        "Abbott", "Archer", "Baker", "Barlow", "Bishop", "Blake", "Carter", "Chapman", "Clayton", "Cole", "Cooper", "Dalton", "Dixon", "Drake",
        "Eaton", "Ellis", "Farmer", "Fisher", "Fletcher", "Foster", "Gardner", "Gibson", "Grant", "Hale", "Harper", "Hobbs", "Hughes", "Irwin",
        "Jarvis", "Kemp", "Kirby", "Lambert", "Lawson", "Marsh", "Mason", "Mercer", "Nash", "Newton", "Norris", "Osborne", "Parker", "Pearce",
        "Porter", "Quick", "Reed", "Rhodes", "Sawyer", "Shaw", "Slater", "Tanner", "Thorne", "Turner", "Vance", "Walsh", "Ward", "Weaver", "Webb",
        "York",
    ],
}
STREETS = {
    "fr": [
        "rue des Lilas", "rue du Moulin", "avenue de la Gare", "place du Marché", "chemin des Vignes", "rue de l'Église", "boulevard Voltaire",
        "allée des Tilleuls", "impasse du Lavoir", "quai des Saules", "rue du Puits", "cours Gambetta", "route de Lyon", "rue des Écoles",
        "sentier du Bois", "rue Haute",
    ],
    "en": [
        "Mill Lane", "High Street", "Station Road", "Church Close", "Orchard Way", "Park Avenue", "Bridge Street", "Oak Drive", "Harbour Row",
        "King Street", "Meadow Court", "Victoria Road", "Elm Grove", "Chapel Hill", "Green Lane", "North Parade",
    ],
}
CITIES = {
    "fr": [
        "Angers", "Annecy", "Arras", "Auch", "Bayonne", "Béziers", "Blois", "Bourges", "Caen", "Chartres", "Colmar", "Dax", "Dole", "Épinal", "Foix",
        "Gap", "Laval", "Lorient", "Mâcon", "Nevers", "Niort", "Pau", "Quimper", "Rodez", "Saumur", "Tarbes", "Troyes", "Tulle", "Valence", "Vannes",
    ],
    "en": [
        "Bath", "Bolton", "Bristol", "Derby", "Dover", "Durham", "Exeter", "Halifax", "Hereford", "Ipswich", "Keswick", "Lancaster", "Lincoln",
        "Luton", "Norwich", "Oxford", "Penrith", "Poole", "Reading", "Ripon", "Salford", "Stafford", "Taunton", "Torquay", "Truro", "Wells", "Whitby",
        "Wigan", "Windsor", "Woking",
    ],
}
DOMAINS = {
    "fr": [
        "exemple.fr", "courriel.example", "poste.example", "lettre.example",
    ],
    "en": [
        "mail.example", "example.com", "post.example", "letters.example",
    ],
}


def words(table: dict[str, list[str]], locale: str) -> list[str]:
    return table.get(locale, table["en"])


def _pick(table: dict[str, list[str]], locale: str, seed: Column) -> Column:
    options = words(table, locale)
    return F.get(F.array(*map(F.lit, options)), F.pmod(seed, F.lit(len(options))).cast("int"))


def _digits(seed: Column, n: int) -> Column:
    return F.lpad(F.pmod(seed, F.lit(10**n)).cast("string"), n, "0")


def _plain(name: Column) -> Column:
    """Lower-case letters without accents."""
    return F.translate(F.lower(name), "àâäçéèêëîïôöùûüÿ'- ", "aaaceeeeiioouuuy")


def fake(value: Column, kind: SemanticType, secrets: Secrets) -> Column:
    """A fake of the given type; null stays null; case is ignored."""
    h = hmac_hex(F.lower(value.cast("string")), secrets)
    seed, more = long_of(h), F.conv(F.substring(h, 17, 15), 16, 10).cast("long")  # two independent stretches of the digest
    locale = secrets.locale
    shift = F.shiftright
    if kind == SemanticType.EMAIL:
        user = F.concat(_plain(_pick(FIRST, locale, seed)), F.lit("."), _plain(_pick(LAST, locale, shift(seed, 16))))
        return F.concat(user, F.lit("."), F.substring(h, 11, 6), F.lit("@"), _pick(DOMAINS, locale, shift(seed, 32)))
    if kind == SemanticType.FIRST_NAME:
        return _pick(FIRST, locale, seed)
    if kind == SemanticType.LAST_NAME:
        return _pick(LAST, locale, seed)
    if kind == SemanticType.PHONE:
        d = _digits(more, 9)
        if locale == "fr":
            return F.concat(F.lit("0"), (F.pmod(seed, F.lit(5)) + 1).cast("string"), *(F.concat(F.lit(" "), F.substring(d, k, 2)) for k in (1, 3, 5, 7)))
        return F.concat(F.lit("555-"), F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 4))
    if kind == SemanticType.ADDRESS:
        number = (F.pmod(more, F.lit(199)) + 1).cast("string")
        code = _digits(shift(more, 12), 5)
        return F.concat(number, F.lit(" "), _pick(STREETS, locale, seed), F.lit(", "), code, F.lit(" "), _pick(CITIES, locale, shift(seed, 24)))
    if kind == SemanticType.IBAN:
        body = F.concat(_digits(seed, 12), _digits(more, 11))  # 23 digits, country FR
        check = F.lit(98) - F.pmod(F.concat(body, F.lit("152700")).cast("decimal(38,0)"), F.lit(97).cast("decimal(38,0)")).cast("int")
        return F.concat(F.lit("FR"), F.lpad(check.cast("string"), 2, "0"), body)
    if kind == SemanticType.IP_ADDRESS:
        part = lambda s, n, low=0: (F.pmod(s, F.lit(n)) + low).cast("string")
        dot = F.lit(".")
        return F.concat(part(shift(seed, 24), 223, 1), dot, part(shift(seed, 16), 256), dot, part(shift(seed, 8), 256), dot, part(seed, 254, 1))
    raise RuleError("CONFIG_FAKE_TYPE", f"no fake for {kind}; JSON goes by its paths")

