"""US / non-US / unknown by ordered steps over the parts, words and text of a location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import let

# Names and codes by which locations are recognised.
US_NAMES = ["us", "usa", "u.s.", "u.s.a.", "united states", "united states of america"]
STATE_CODES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc pr gu vi as mp"
).split()
STATE_NAMES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana",
    "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada",
    "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island",
    "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming",
    "district of columbia", "puerto rico", "guam",
]
#: Countries by ISO 3166 that are places in the United States here.
TERRITORIES = ["pr", "gu", "vi", "as", "mp", "um"]
US_CITIES = [
    "nyc", "dmv", "chicago", "boston", "seattle", "philadelphia", "philly", "houston", "dallas", "austin", "atlanta", "denver", "minneapolis", "pittsburgh", "detroit",
    "phoenix", "nashville", "charlotte", "baltimore", "orlando", "tampa", "raleigh", "cleveland", "cincinnati", "indianapolis", "albuquerque", "brooklyn", "manhattan",
    "harlem", "bronx", "queens", "new york city", "san francisco", "silicon valley", "los angeles", "san diego", "jersey city", "kansas city", "st louis", "st. louis",
    "saint louis", "new orleans", "salt lake city", "las vegas", "long island",
]
FOREIGN_CITIES = [
    "bangalore", "bengaluru", "hyderabad", "mumbai", "pune", "chennai", "noida", "tokyo", "osaka", "seoul", "taipei", "shanghai", "beijing", "shenzhen", "hong kong",
    "singapore", "sydney", "melbourne", "auckland", "london", "manchester", "edinburgh", "dublin", "paris", "lyon", "berlin", "munich", "frankfurt", "hamburg",
    "amsterdam", "rotterdam", "brussels", "zurich", "geneva", "vienna", "stockholm", "oslo", "copenhagen", "helsinki", "madrid", "barcelona", "lisbon", "rome", "milan",
    "milano", "warsaw", "warszawa", "krakow", "kraków", "gdansk", "wrocław", "wroclaw", "prague", "budapest", "bucharest", "athens", "istanbul", "tel aviv", "dubai",
    "abu dhabi", "cairo", "jakarta", "manila", "bangkok", "kuala lumpur", "ho chi minh", "toronto", "montreal", "vancouver", "ottawa", "calgary", "edmonton",
    "mexico city", "guadalajara", "monterrey", "sao paulo", "são paulo", "rio de janeiro", "buenos aires", "bogota", "santiago", "lima",
]
#: (two-letter code, three-letter code, names). A default for common origins; `all_countries` gives the whole ISO 3166 table.
COUNTRIES = [
    ("gb", "gbr", "united kingdom|great britain|uk|england|scotland|wales|northern ireland"), ("tw", "twn", "taiwan"), ("ru", "rus", "russia|russian federation"),
    ("ci", "civ", "ivory coast|côte d'ivoire"), ("de", "deu", "germany"), ("ca", "can", "canada"), ("in", "ind", "india"), ("fr", "fra", "france"), ("pl", "pol", "poland"),
    ("mx", "mex", "mexico"), ("ie", "irl", "ireland"), ("nl", "nld", "netherlands|holland"), ("es", "esp", "spain"), ("it", "ita", "italy"), ("pt", "prt", "portugal"),
    ("ch", "che", "switzerland"), ("at", "aut", "austria"), ("be", "bel", "belgium"), ("se", "swe", "sweden"), ("no", "nor", "norway"), ("dk", "dnk", "denmark"),
    ("fi", "fin", "finland"), ("cz", "cze", "czechia|czech republic"), ("hu", "hun", "hungary"), ("ro", "rou", "romania"), ("gr", "grc", "greece"), ("tr", "tur", "turkey|türkiye"),
    ("il", "isr", "israel"), ("ae", "are", "united arab emirates|uae"), ("eg", "egy", "egypt"), ("jp", "jpn", "japan"), ("kr", "kor", "south korea|korea"), ("cn", "chn", "china"),
    ("hk", "hkg", "hong kong"), ("sg", "sgp", "singapore"), ("au", "aus", "australia"), ("nz", "nzl", "new zealand"), ("br", "bra", "brazil"), ("ar", "arg", "argentina"),
    ("cl", "chl", "chile"), ("co", "col", "colombia"), ("pe", "per", "peru"), ("ph", "phl", "philippines"), ("id", "idn", "indonesia"), ("th", "tha", "thailand"),
    ("my", "mys", "malaysia"), ("vn", "vnm", "vietnam"), ("ua", "ukr", "ukraine"), ("ng", "nga", "nigeria"), ("ke", "ken", "kenya"), ("za", "zaf", "south africa"),
]


def all_countries(spark: SparkSession, more=COUNTRIES) -> list[tuple[str, str, str]]:
    """ISO 3166 but for the United States and its territories with a state code, by the JVM's own table; names of `more` are further names."""
    locale = spark._jvm.java.util.Locale
    names: dict[str, tuple[str, list[str]]] = {}
    for code in locale.getISOCountries():
        country = locale("", code)
        two = code.lower()
        if two != "us" and two not in TERRITORIES:
            names[two] = (country.getISO3Country().lower(), [country.getDisplayCountry(locale.ENGLISH).lower()])
    for two, three, all_ in more:
        known = names.setdefault(two, (three, []))[1]
        known += [n for n in all_.split("|") if n not in known]
    return [(two, three, "|".join(n)) for two, (three, n) in sorted(names.items())]


def location_class(location: Column, countries=COUNTRIES) -> Column:
    """us, non_us or unknown."""
    codes = [c for two, three, _ in countries for c in (two, three)]
    names = [n for _, _, all_ in countries for n in all_.split("|")]
    some = lambda array, values: F.exists(array, lambda x: x.isin(values))

    def steps(text, parts, words):
        inside = lambda values: text.rlike("|".join(v.replace(".", "\\.") for v in values))
        first, second, n = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.size(parts)
        leading = (n >= 2) & first.isin(codes) & (some(F.slice(parts, F.lit(2), F.greatest(n, F.lit(1))), FOREIGN_CITIES) | ((n >= 3) & (F.length(first) <= 3) & (F.length(second) <= 3)))
        return (
            F.when(text == "", "unknown")
            .when(some(parts, US_NAMES + STATE_NAMES) | some(words, US_NAMES + STATE_NAMES) | text.rlike(r"(?<![a-z0-9_])united states(?![a-z0-9_])"), "us")
            .when((n >= 3) & F.element_at(parts, -1).isin(codes), "non_us")
            .when(leading, "non_us")
            .when(some(parts, STATE_CODES), "us")
            .when(some(parts, codes + names), "non_us")
            .when(some(parts, US_CITIES) | some(words, US_CITIES) | inside([c for c in US_CITIES if len(c) >= 5]), "us")
            .when(inside([c for c in names if len(c) >= 5]) | inside(FOREIGN_CITIES), "non_us")
            .otherwise("unknown")
        )

    # text, parts and words are worked out once for all steps
    parts_of = lambda text: F.filter(F.transform(F.split(text, "[,\\-|·/]"), lambda p: F.trim(p)), lambda p: p != "")
    words_of = lambda parts: F.filter(F.flatten(F.transform(parts, lambda p: F.split(p, r"\s+"))), lambda w: w != "")
    text = F.trim(F.lower(F.coalesce(location, F.lit(""))))
    return let(text, lambda t: let(parts_of(t), lambda p: let(words_of(p), lambda w: steps(t, p, w))))


def with_location_class(df: DataFrame, countries=COUNTRIES) -> DataFrame:
    return df.withColumn("location_class", location_class(F.col("location"), countries))
