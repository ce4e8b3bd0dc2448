"""The small labelled URL table of the URL filter: addresses as a person would sort them."""

import re
import zlib

# Addresses to block, then addresses to allow.
BLOCK = """
https://www.best-casino-bonus.com/slots/free-spins
http://casino-royal-online.net/register?promo=500
https://m.luckyslots777.com/jackpot
https://poker-night-bets.com/en/deposit
https://www.sportsbets24.com/live-odds/football
https://bet-now-win.net/odds/today.html
http://free-spins-casino.org/bonus/no-deposit
https://online-roulette-vip.com/games
https://jackpot-lottery-winner.com/claim?id=8831
http://lottery-results-win.net/prize/claim.html
https://www.mega-slots-vegas.com/play/
https://winbigcasino.info/welcome-bonus
https://adult-chat-rooms.com/live/cams
https://www.hotxxxvideos.com/watch/4412
http://free-porn-tube.net/videos/new
https://xxx-adult-movies.org/category/amateur
https://sexy-singles-dating.com/join
https://m.escort-girls-city.com/listing/19
https://nude-cams-live.net/models
http://porn-pics-free.com/gallery/812
https://sex-shop-cheap.com/toys?page=3
https://adultfriend-hookup.com/signup
https://cheap-viagra-online.com/order
http://buy-pills-no-prescription.net/cialis
https://discount-meds-pharmacy.biz/pills/weight-loss
https://viagra-generic-shop.com/cart
https://www.miracle-diet-pills.com/lose-weight-fast
https://cbd-gummies-cheap.net/offer
https://spam-link-farm.com/page/1
http://seo-backlinks-cheap.net/buy-links
https://link-farm-directory.biz/submit.php
https://buy-followers-likes.com/instagram
https://clickbait-farm.net/you-wont-believe
https://spam-blog-network.com/tag/cheap
https://traffic-clicks-bot.com/buy
http://ads-tracker-click.com/redirect?url=aff
https://adserver-popunder.net/banner/728x90
https://track-click-ads.com/pixel.gif
https://popads-redirect.biz/landing
https://ad-network-clicks.com/serve/js
http://doubleads-track.net/impression?id=3
https://affiliate-track-offers.com/click/991
https://get-rich-quick-crypto.com/invest
https://bitcoin-doubler-free.net/send
https://earn-money-fast-home.com/join-now
http://free-iphone-winner.com/claim-prize
https://gift-card-generator-free.net/unlock
https://cheap-replica-watches.com/rolex
http://discount-handbags-outlet.biz/sale
https://payday-loans-instant.com/apply
https://cheap-loan-now.net/no-credit-check
https://fake-diploma-buy.com/order
https://essay-writing-cheap.com/order-now
http://warez-crack-keygen.net/download/serial
https://free-movies-torrent.biz/watch-online
https://keygen-serial-cracks.com/win
https://phishing-login-verify.com/account/update
https://secure-bank-verify.net/login.php
http://your-account-suspended.com/confirm
https://prize-winner-survey.com/start
"""
ALLOW = """
https://www.citylibrary.org/catalogue/search?q=history
https://docs.python-guide.org/tutorial/classes.html
https://en.openencyclopedia.org/wiki/Photosynthesis
https://www.university.edu/physics/courses/quantum-mechanics
https://news.dailyherald.com/2021/05/12/city-council-budget
https://www.museum-of-science.org/exhibits/space
https://blog.engineering-notes.com/posts/distributed-systems
https://www.gardening-help.co.uk/vegetables/tomatoes
https://kitchen-recipes.net/soups/lentil-soup
https://www.weather-service.gov/forecast/monday
https://forum.woodworkers.org/threads/dovetail-joints.4421
https://maps.oldtown.org/streets/index
https://archive.newspapers.org/1923/october/7
https://www.health-institute.org/topics/asthma
https://law.justice-department.gov/statutes/title-12
https://www.parliament.uk.example/debates/2019
https://travel-journal.net/italy/rome-walking-tour
https://music-theory.org/lessons/harmony
https://m.sports-report.com/football/premier-league/table
https://books.publishing-house.com/novels/new-releases
https://www.railway-timetable.de/berlin/hamburg
https://de.wissen-portal.de/geschichte/mittelalter
https://www.stadtbibliothek.de/angebote/kinder
https://fr.encyclopedie-libre.fr/article/chimie
https://www.ecole-primaire.fr/actualites/rentree
https://cuisine-facile.fr/recettes/gateau
https://es.noticias-locales.es/2020/03/ayuntamiento
https://www.universidad.es/facultad/derecho
https://museo-nacional.es/colecciones/pintura
https://static.software-project.io/docs/v2/install
https://github-mirror.dev/project/readme
https://www.open-standards.org/specifications/http
https://wiki.linux-users.org/index.php/Kernel
https://help.office-suite.com/en/articles/print-settings
https://support.camera-maker.com/manuals/lens
https://shop.bookstore.com/cart/checkout
https://www.bakery-on-main.com/about
https://school-district.org/calendar/2022
https://www.choir-society.org/concerts
https://photo-club.net/gallery/landscapes
https://astronomy-magazine.com/articles/black-holes
https://www.bird-watching.org/species/robin
https://climate-research.org/papers/2018/arctic
https://history.archives.gov/records/1860
https://www.theatre-royal.co.uk/whats-on
https://farmers-market.org/vendors
https://chess-club.net/openings/sicilian
https://www.hospital-trust.org/visiting-hours
https://philosophy.lectures.edu/kant/notes
https://www.small-town-news.com/obituaries
https://math-exercises.org/algebra/quadratic
https://bike-repair.net/brakes/adjusting
https://api.data-portal.gov/v1/datasets/42
https://www.cathedral.org/tours
https://language-learning.com/german/verbs
https://mountain-hiking.ch/routes/alps
https://blog.home-cooking.com/bread/sourdough
https://forum.aquarium-keepers.net/topic/883
https://www.electric-cars-review.com/models/compact
https://sailing-club.co.nz/races/results
https://city-transport.org/tickets/monthly
https://www.art-school.edu/admissions
https://knitting-patterns.net/sweaters/child
https://research.labs.org/publications/neural-networks
https://www.insurance-advice.org/home/claims
https://podcast.science-hour.com/episodes/112
https://www.wildlife-park.org/animals/otters
https://old-maps.net/europe/1750
https://www.orchestra.org/season/program
https://courses.online-college.edu/biology/cells
https://poetry-archive.org/poems/autumn
https://www.plumbing-guide.com/leaks/taps
https://economics.policy-institute.org/trade
https://www.village-hall.org.uk/events
https://geology.survey.gov/rocks/granite
https://films.review-weekly.com/drama/2017
https://www.football-league.org/fixtures
https://bus-timetables.co.uk/route/14
https://craft-ideas.net/paper/origami
https://www.veterinary-clinic.com/cats/vaccines
https://m.daily-crossword.com/puzzle/monday
https://genealogy.family-trees.org/surnames/miller
https://www.swimming-pool.org/opening-times
https://teachers.lesson-plans.org/grade-4/fractions
https://www.national-park.gov/trails/map
https://blog.photography-tips.net/exposure
https://nutrition.food-facts.org/apples
https://www.church-bells.org/history
https://robotics.student-club.edu/projects
https://www.antique-clocks.net/restoration
"""


# Words of hosts to block, and of hosts to allow.
UNWANTED = "ads adult bets bonus casino cheap clicks escort farm free jackpot lottery pills poker porn sex slots spam track viagra win xxx loans replica"
WANTED = ("archive blog books city community docs forum garden history kitchen law library maps museum music news science school travel wiki "
          "health weather sports village")


def _pairs(words: list[str]) -> list[str]:
    """Addresses of every word alone and beside seven others."""
    out = [f"http://{w}.com/index.html" for w in words]
    return out + [f"https://{w}-{words[(i + step) % len(words)]}.com/{i * step}" for i, w in enumerate(words) for step in (1, 2, 3, 5, 7, 9, 11)]


def _names(count: int = 100) -> list[str]:
    """Addresses of pronounceable names that mean nothing: allowed, as nothing speaks against them."""
    onsets, vowels, codas = "b c d f g h l m n p r s t v w th sh ch st tr".split(), "a e i o u ea ou".split(), ["", "n", "r", "s", "th", "nd", "ng", "st"]
    out = []
    for i in range(count):
        x, name = zlib.crc32(str(i).encode()), ""
        for _ in range(2 + x % 2):
            name += onsets[x % 20] + vowels[x // 20 % 7] + codas[x // 140 % 8]
            x //= 1120
        out.append(f"https://{name}.com/{('news', 'en', 'shop', 'p', 'index.html')[i % 5]}/{i}")
    return out


# What may stand before and after the name of a host without saying anything about it.
FRONTS, ENDS = ("", "www.", "m.", "blog."), (".com", ".net", ".org")
_FRONT, _END = re.compile(r"^(www|m|blog|news|docs|forum|help|support|de|fr|es|en)\.(?=[^.]*\.)"), re.compile(r"(\.co)?\.[a-z]+$")


def addresses() -> list[tuple[str, str, str, str, float]]:
    """(address, scheme, name, rest, label) of every labelled address, label 1 for addresses to block.

    The name is the host without its front and end. Under each of FRONTS and ENDS, which so tell nothing about the label, an
    address gives one row of the table.
    """
    out = []
    for label, listed in ((1.0, BLOCK.split() + _pairs(UNWANTED.split())), (0.0, ALLOW.split() + _pairs(WANTED.split()) + _names())):
        for address in listed:
            scheme, _, rest = address.partition("://")
            host, slash, path = rest.partition("/")
            out.append((address, scheme, _END.sub("", _FRONT.sub("", host)), slash + path, label))
    return out
