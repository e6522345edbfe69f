"""URL filter: allow/block rules on host and path, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, map_slices, ngram_hashes

DIM = 1 << 15
GRAMS = (3, 4, 5)

#: (host, path, verdict); the host stands for itself and all its subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

# The labelled urls, whole as they stand.
UNWANTED = """
http://www.free-porn-clips.com/teens/video-12.html https://pornhaven.net/hd http://xxxmovies.biz/archive/2019 https://sexcams-live.com/rooms/new http://hotsexdating.info/join
https://www.nudegirls.org/gallery/44 http://eroticstories.net/page/3 https://escort-agency-vip.com/berlin http://hardcore-tube.com/watch?v=1 https://camgirls.tv/online
http://adultvideos-free.com/new https://fetish-club.net/members http://milfs-hunter.biz/tour https://hentaicomics.org/read/88 http://stripshow-webcams.com/signup
https://onlynudes.club/latest http://swingers-contacts.info/local https://playgirl-models.net/pics http://lesbian-xxx.org/hd https://sexshop-discreet.com/toys
http://pornostars.de/filme https://sexgeschichten.net/neu http://video-porno.it/gratis https://chicas-desnudas.es/fotos http://rencontre-sexy.fr/inscription
http://casino-royal-bonus.com/play https://online-poker-room.net/download http://bet-sports365.com/odds https://slotsmania.biz/free-spins http://www.roulette-wheel.com/live
https://blackjack21.org/bonus http://jackpotcity-win.com/ https://bingo-cash.net/welcome-bonus http://sportsbook-odds.com/nba https://lottery-winner.info/claim
http://baccarat-live.com/table/3 https://gambling-tips.biz/sure-wins http://casinos-en-ligne.fr/bonus https://wetten-bonus.de/gratis http://apuestas-casino.es/ruleta
http://buy-viagra-cheap.com/order https://cialis-online.net/pharmacy http://levitra4you.biz/no-prescription https://dietpills-fast.com/buy http://canadian-meds.info/xanax
https://steroids-shop.org/cart http://tramadol-overnight.com/ https://weightlossmiracle.biz/garcinia http://malepills.net/enlargement https://cheap-meds-rx.com/valium
http://hgh-supplements.info/order https://penis-enlargement-pills.com/ http://viagra-ohne-rezept.de/kaufen https://comprar-viagra.es/oferta http://pillole-cialis.it/acquista
http://warez-downloads.org/full https://cracked-games.net/keygen http://serial-keys.biz/windows https://torrents-mega.com/movies http://nulled-scripts.info/download
https://freecracks.org/photoshop http://pirated-software.net/ https://hacked-accounts.biz/list http://keygens.ru/all https://apk-mods-unlimited.com/coins
http://secure-login-verify.info/bank/account https://account-suspended-update.com/signin http://bank-verify-alert.net/confirm https://win-phone-prize.com/claim http://free-giftcards.biz/now
https://claim-your-reward.info/survey http://paydayloans-now.com/apply https://instant-loan-approval.biz/ http://bitcoin-doubler.net/invest https://make-money-fast.info/home
http://get-rich-quick.biz/secret https://crypto-profit-bot.com/signup http://fake-watches.net/luxury https://replica-handbags.biz/outlet http://cheap-followers.com/likes
https://spam-mailer.biz/bulk http://seo-backlinks-cheap.net/buy https://clickbait-traffic.info/popunder http://virus-alert-fix.com/scan-now https://your-pc-infected.info/call
http://miracle-cure.biz/secret https://hot-singles-nearby.com/chat http://sugar-daddy-dating.net/ https://mailorderbrides.info/catalog http://counterfeit-money.biz/notes
https://news-site.org/xxx/porn.html http://files.co/warez/crack.zip https://blog.me/cheap-viagra-pills http://page.info/casino-free-spins https://host.net/sex/cams http://forum.biz/phishing-kit
""".split()
ORDINARY = """
https://www.essex.ac.uk/departments/history http://library.sussex.ac.uk/catalogue/2021 https://middlesexhospital.org/clinics http://sextant-navigation.org/instruments https://dataanalysis.io/tutorials/regression
http://www.cocktails.com/recipes/lemon https://cockpit-project.org/docs http://alphabet-learning.com/kids https://specialists.org/doctors http://www.socialist-history.net/archive
https://therapists.org/find http://pharmacology.edu/lectures https://viaggi-italia.it/roma http://classics.edu/latin https://assessment.edu/forms
http://grapefruit-growers.org/press https://pillows.com/bedroom http://timeslots.org/booking https://bettertogether.org/events http://cameras.com/lenses/50mm
https://scampi-recipes.com/prawns http://spinach.org/salads https://windowsupdate.com/kb/2014 http://nutrition.org/diet/vegetables https://crackers-and-cheese.com/lunch
http://analytics.io/reports/2020 https://hackathon.org/teams http://adulteducation.org/evening-classes https://loans-library.org/books http://prize.org/physics/1921
https://lotteries-commission.gov/rules http://wine-tours.fr/bordeaux https://mathworks.org/matrices http://www.castle-museum.co.uk/visit https://blog.gardeners.com/roses/spring
http://news.daily.org/politics/2021/election.html https://en.encyclopedia.org/wiki/Butterfly http://docs.python-guide.org/install https://shop.bookstore.com/fiction/novels http://forum.cyclists.net/thread/8812
https://recipes.kitchen.com/soup/tomato http://www.university.edu/chemistry/lab https://museum.org/exhibitions/now http://weather.gov/forecast/coast https://travel-notes.com/japan/kyoto
http://www.railway-society.org/timetable https://football-club.co.uk/fixtures http://music-school.org/piano/lessons https://farmersmarket.org/vegetables http://dentist-clinic.com/contact
https://photo-archive.org/1930/london http://parliament.uk/bills/read https://orchestra.org/concerts/tickets http://wildlife-trust.org/birds/owls https://linux-kernel.org/releases
http://jobs.engineering.com/search https://village-hall.org/calendar http://cityhistory.net/maps/1850 https://poetry.org/sonnets/18 http://knitting-patterns.com/socks
https://api.weather.io/v2/stations http://support.software.com/faq/login https://accounts.university.edu/signin http://pay.council.gov.uk/tax https://charity.org/donate/now
http://www.buycycles.com/helmets https://download.opensource.org/latest http://free-software.org/licenses https://order.pizza.com/menu http://winter-sports.org/ski
https://online-courses.edu/algebra http://bonus-tracks.com/album/7 https://clubhouse.org/members http://www.hotels.com/paris/cheap https://game-design.edu/students
http://tube-map.london/lines https://moneyhistory.org/coins http://securecoding.org/guide https://survey.stats.gov/households http://datingfossils.org/carbon
https://www.rezepte.de/kuchen/apfel http://schule.de/klasse/5 https://bibliothek.de/buecher http://wetter.de/berlin https://zeitung.de/wirtschaft
http://cuisine.fr/recettes/tarte https://mairie.fr/services http://journal.fr/politique https://bibliotheque.fr/livres http://meteo.fr/paris
https://recetas.es/paella http://ayuntamiento.es/tramites https://periodico.es/deportes http://biblioteca.es/libros https://viajes.es/sevilla
http://ricette.it/pasta https://comune.it/servizi http://giornale.it/cultura https://musei.it/firenze http://scuola.it/orari
http://tulorin.org/merash/12.html https://kestrova.net/daluth http://quenish.com/borite/lamu https://zaprilo.org/page/3 http://mirvanto.io/ https://dolphex.de/en/about
""".split()
SUFFIXES = "com org net info biz edu io dev co.uk ac.uk gov.uk de fr es it nl".split()
FRONTS = ("", "", "www.", "m.", "blog.", "en.", "shop.")
PLAIN = "en es fr de 2021 2024 index.html page list item search archive account update user login click view buy order cheap free win now today online best".split()
#: Characters that stand for letters where they touch one.
LOOKALIKES = str.maketrans("013457@$", "oieastas")


def _made_up(rng: random.Random) -> str:
    """A word of no meaning: what most hosts are called."""
    return "".join(rng.choice("b c d f g h k l m n p r s t v w st th tr br ch sh".split()) + rng.choice("a e i o u ai ea ou".split()) + rng.choice(("", "", "n", "r", "l", "s", "t", "x", "ng")) for _ in range(rng.choice((1, 2, 2, 3))))


def misspelt(url: str, rng: random.Random) -> str:
    """`url` with two of its words written otherwise: a lookalike for a letter, or one doubled, left out or swapped."""
    scheme, _, rest = url.partition("://")
    words = list(re.finditer("[a-z]{4,}", rest))
    for m in sorted(rng.sample(words, min(len(words), 2)), key=lambda m: -m.start()):
        w, kind, i = m[0], rng.randrange(5), rng.randrange(1, len(m[0]) - 1)
        alike = [j for j, c in enumerate(w) if c in "oieast"]
        if kind < 2 and alike:
            j = rng.choice(alike)
            w = w[:j] + "013457"["oieast".index(w[j])] + w[j + 1 :]
        else:
            w = w[:i] + {0: w[i:], 1: w[i:], 2: w[i] + w[i:], 3: w[i + 1 :], 4: w[i + 1] + w[i] + w[i + 2 :]}[kind]
        rest = rest[: m.start()] + w + rest[m.end() :]
    return f"{scheme}://{rest}"


def made_up_urls(n: int, seed: int) -> list[str]:
    """Urls of words of no meaning, with plain parts in their paths."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        host = rng.choice(("-", "")).join(_made_up(rng) for _ in range(rng.choice((1, 1, 2))))
        parts = [rng.choice(PLAIN) if rng.random() < 0.4 else _made_up(rng) for _ in range(rng.choice((0, 1, 1, 2)))] + [str(rng.randrange(10 ** rng.randrange(1, 6)))] * (rng.random() < 0.4)
        out.append(f"http://{rng.choice(FRONTS)}{host}.{rng.choice(SUFFIXES)}/{'/'.join(parts)}")
    return out


def labelled_urls(unwanted=tuple(UNWANTED), ordinary=tuple(ORDINARY), variants: int = 3, made_up: int = 100, seed: int = 10) -> tuple[tuple[str, int], ...]:
    """(url, 1 to block): the small table that the regression learns from.

    Each url stands as it is and in so many misspellings; both labels are misspelt alike. Made-up urls and the one
    without host and path are ordinary.
    """
    rng, own = random.Random(seed), [(u, 1) for u in unwanted] + [(u, 0) for u in ordinary]
    rows = own + [(misspelt(u, rng), y) for u, y in own for _ in range(variants)]
    return tuple(rows + [(u, 0) for u in made_up_urls(made_up, seed)] + [("", 0)] * 4)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: the host A-Z lower-cased; both empty for null or without `://`."""
    tail = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null where none does. Equal lengths: the first in text order."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        made = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def letters(text: str) -> str:
    """Lower case, with lookalikes as the letters that they stand for where they touch one."""
    return re.sub(r"(?<=[a-z])[013457@$]+|[013457@$]+(?=[a-z])", lambda m: m[0].translate(LOOKALIKES), text.lower())


def _grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of `^host$` and `^path$` of all rows, in letters, and their rows. Host and path share weights."""
    slots, rows = [], []
    for texts in (hosts, paths):
        parts = [b"^" + letters(t).encode("utf-8", "surrogatepass") + b"$" for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        for n in GRAMS:
            h = ngram_hashes(data, n, 11 + 10 * n)
            inside = owner[: len(h)] == owner[n - 1 : n - 1 + len(h)]
            slots.append((h[inside] & np.uint64(DIM - 1)).astype(np.int64))
            rows.append(owner[: len(h)][inside])
    return np.concatenate(slots), np.concatenate(rows)


def _plain_split(url: str) -> tuple[str, str]:
    tail = url.partition("://")[2]
    cut = min((i for i in (tail.find(c) for c in "/?#") if i >= 0), default=len(tail))
    path = tail[cut:]
    return tail[:cut].lower(), path[: min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@functools.cache
def fit(labelled: tuple[tuple[str, int], ...], epochs: int = 500, rate: float = 4.0, ridge: float = 3e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) by full-batch gradient descent over the small labelled table; the same on every run.

    Both labels weigh the same. An empty table gives weights and bias of 0 less a little: it blocks nothing.
    """
    if not labelled:
        return np.zeros(DIM), -1.0
    slot, row = _grams(*map(list, zip(*[_plain_split(u) for u, _ in labelled], strict=True)))
    y = np.array([v for _, v in labelled], float)
    unit = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(y))))
    weight = np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())) / 2
    w, b = np.zeros(DIM), 0.0
    for _ in range(epochs):
        g = (_sigmoid(np.bincount(row, w[slot], len(y)) * unit + b) - y) * weight
        w -= rate * (np.bincount(slot, (g * unit)[row], DIM) + ridge * w)
        b -= rate * g.sum()
    return w, b


def url_scores(model: tuple[np.ndarray, float], hosts: list[str], paths: list[str]) -> np.ndarray:
    """Chances that urls are unwanted; each depends on its own host and path alone. Without n-grams, the bias decides."""
    w, b = model
    slot, row = _grams(hosts, paths)
    return _sigmoid(np.bincount(row, w[slot], len(hosts)) / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(hosts)))) + b)


def classify_urls(pages: DataFrame, rules=RULES, labelled: tuple[tuple[str, int], ...] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of `pages`.

    The verdict is the longest fitting rule's; without one it is `block` where the regression's score is at least
    `threshold`, else `allow`. A row that a rule judges is not scored (null). A null or malformed url has empty host
    and path and scores as an ordinary url does. Rows that repeat are judged each, an empty table gives no rows.
    Columns other than page_id and url are not read, so clashing names do no harm. `labelled` are (url, 1 to block),
    labelled_urls() by default; the model has a fixed size and goes to the tasks with the function. Nothing is shuffled.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    parts = parts.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled"))
    model = fit(labelled_urls() if labelled is None else labelled)

    def make():
        def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
            ruled = batch.column("ruled")
            free = np.flatnonzero(ruled.is_null().to_numpy(zero_copy_only=False))
            hosts, paths = (batch.column(n).take(pa.array(free)).to_pylist() for n in ("host", "path"))
            score = np.full(batch.num_rows, np.nan)
            score[free] = url_scores(model, hosts, paths) if len(free) else ()
            own = np.where(score >= threshold, "block", "allow")
            verdict = [r or o for r, o in zip(ruled.to_pylist(), own.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(score, pa.float64(), from_pandas=True)], ["page_id", "host", "path", "rule", "verdict", "score"])

        return judge

    return map_slices(parts, make, "page_id long, host string, path string, rule string, verdict string, score double", rows=2048)
