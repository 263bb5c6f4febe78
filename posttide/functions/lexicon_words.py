"""Word lists of the lexicon scorer, after the published method (Hutto & Gilbert 2014).

Fixed values. The seed lexicon is a small sample; scores equal the published ones
only when the full published list is given as the lexicon table.
"""

from __future__ import annotations

BOOST = 0.293
DAMP = -0.293

BOOSTERS = dict.fromkeys(
    """absolutely amazingly awfully completely considerable considerably decidedly deeply
    effing enormous enormously entirely especially exceptional exceptionally extreme
    extremely fabulously flipping frackin fully greatly hella highly hugely incredible
    incredibly intensely major majorly more most particularly purely quite really
    remarkably so substantially thoroughly total totally tremendous tremendously uber
    unbelievably unusually utter utterly very""".split(),
    BOOST,
) | dict.fromkeys(
    """almost barely hardly kinda kindof less little marginal marginally occasional
    occasionally partly scarce scarcely slight slightly somewhat sorta sortof""".split(),
    DAMP,
)
BOOSTER_PAIRS = {"just enough": DAMP, "kind of": DAMP, "sort of": DAMP}

NEGATIONS = tuple(
    """aint arent cannot cant couldnt darent despite didnt doesnt dont hadnt hasnt havent
    isnt mightnt mustnt neednt neither never none nope nor not nothing nowhere oughtnt
    rarely seldom shant shouldnt uhuh wasnt werent without wont wouldnt""".split()
)

IDIOMS = {
    "bad ass": 1.5,
    "beating heart": 3.1,
    "broken heart": -2.9,
    "bus stop": 0.0,
    "kiss of death": -1.5,
    "the bomb": 3.0,
    "to die for": 3.0,
    "yeah right": -2.0,
}

SEED_LEXICON = {
    "abuse": -3.2, "amazing": 2.8, "angry": -2.3, "annoying": -1.7, "awesome": 3.1,
    "awful": -2.0, "bad": -2.5, "beautiful": 2.9, "best": 3.2, "better": 1.9,
    "boring": -1.3, "broken": -2.1, "brilliant": 2.8, "calm": 1.3, "celebrate": 2.7,
    "charming": 2.8, "cheerful": 2.5, "clever": 2.0, "confused": -1.3, "cool": 1.3,
    "crash": -1.7, "crazy": -1.4, "cruel": -2.8, "cry": -2.1, "damage": -2.2,
    "danger": -2.4, "dead": -3.3, "delight": 2.9, "delightful": 2.8, "delicious": 2.7,
    "disappointed": -2.1, "disappointing": -2.2, "disaster": -3.1, "dislike": -1.6,
    "doubt": -1.5, "easy": 1.9, "elegant": 2.1, "enjoy": 2.2, "evil": -3.4,
    "excellent": 2.7, "excited": 1.4, "fail": -2.5, "failure": -2.3, "fantastic": 2.6,
    "fear": -2.2, "fine": 0.8, "fraud": -2.8, "free": 2.3, "fresh": 1.3,
    "friendly": 2.2, "frustrating": -1.9, "fun": 2.3, "glad": 2.0, "good": 1.9,
    "great": 3.1, "happy": 2.7, "harm": -2.5, "hate": -2.7, "hell": -3.6, "help": 1.7,
    "helpful": 1.8, "hope": 1.9, "horrible": -2.5, "hurt": -2.4, "impressive": 2.3,
    "improve": 1.9, "improvements": 1.3, "joy": 2.8, "kill": -3.7, "kind": 2.4,
    "laugh": 2.6, "lie": -1.6, "like": 1.5, "lose": -1.7, "loss": -1.3, "love": 3.2,
    "lovely": 2.8, "lucky": 1.8, "mad": -2.2, "mess": -1.5, "miss": -0.6,
    "nasty": -2.6, "nice": 1.8, "no": -1.2, "ok": 1.2, "okay": 0.9, "pain": -2.3,
    "perfect": 2.7, "pleasant": 2.3, "poor": -2.1, "pretty": 2.2, "problem": -1.7,
    "proud": 2.1, "safe": 1.9, "sad": -2.1, "scam": -2.7, "scared": -1.9,
    "shame": -2.1, "sick": -2.3, "smart": 1.7, "smile": 1.5, "sorry": -0.3,
    "special": 1.7, "strong": 2.3, "stupid": -2.4, "success": 2.7, "suck": -1.9,
    "support": 1.7, "terrible": -2.1, "terrific": 2.1, "thank": 1.5, "thanks": 1.9,
    "threat": -2.4, "trust": 2.3, "ugly": -2.3, "unhappy": -1.8, "useful": 1.9,
    "useless": -1.8, "victory": 2.8, "warm": 0.9, "weak": -1.9, "win": 2.8,
    "wonderful": 2.7, "worried": -1.2, "worse": -2.1, "worst": -3.1, "wow": 2.8,
    "wrong": -2.1, "yes": 1.7,
}
