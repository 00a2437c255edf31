"""Spellings, labels and season weights that results depend on. Callers pass them, or tables of their own."""

from __future__ import annotations

# Nations as bookmakers spell them, by normalised name (fixed values).
TEAM_ALIASES = {
    "korea republic": "south korea",
    "republic of korea": "south korea",
    "ir iran": "iran",
    "iran": "iran",
    "usa": "united states",
    "united states": "united states",
    "côte d'ivoire": "ivory coast",
    "cote d'ivoire": "ivory coast",
    "czechia": "czech republic",
    "türkiye": "turkey",
    "turkiye": "turkey",
    "bosnia and herzegovina": "bosnia & herzegovina",
}

# Clubs of domestic result files by their canonical names (fixed values).
CLUB_NAMES = {
    "Paris SG": "Paris Saint-Germain",
    "Man City": "Manchester City",
    "Man United": "Manchester United",
    "Nott'm Forest": "Nottingham Forest",
    "Wolves": "Wolverhampton Wanderers",
    "Brighton": "Brighton & Hove Albion",
    "Newcastle": "Newcastle United",
    "Tottenham": "Tottenham Hotspur",
    "Spurs": "Tottenham Hotspur",
    "West Ham": "West Ham United",
    "Leicester": "Leicester City",
    "Norwich": "Norwich City",
    "Sheffield United": "Sheffield Utd",
    "Sheffield Utd": "Sheffield Utd",
    "Bayern Munich": "Bayern Munich",
    "Bayern": "Bayern Munich",
    "Inter": "Inter Milan",
    "Inter Milan": "Inter Milan",
    "AC Milan": "AC Milan",
    "Milan": "AC Milan",
    "Atletico Madrid": "Atlético Madrid",
    "Ath Madrid": "Atlético Madrid",
    "Real Madrid": "Real Madrid",
    "Barcelona": "Barcelona",
    "Dortmund": "Borussia Dortmund",
    "M'gladbach": "Borussia M'gladbach",
    "M Gladbach": "Borussia M'gladbach",
    "Ein Frankfurt": "Eintracht Frankfurt",
    "Leverkusen": "Bayer Leverkusen",
    "Marseille": "Olympique Marseille",
    "Lyon": "Olympique Lyon",
    "Monaco": "AS Monaco",
    "Lille": "Lille OSC",
    "Lens": "RC Lens",
    "Rennes": "Stade Rennais",
    "Nice": "OGC Nice",
}

# Further spellings of clubs, lower-cased (fixed values).
CLUB_ALIASES = {
    "psg": "Paris Saint-Germain",
    "paris sg": "Paris Saint-Germain",
    "paris saint-germain": "Paris Saint-Germain",
    "paris saint germain": "Paris Saint-Germain",
    "arsenal fc": "Arsenal",
    "arsenal": "Arsenal",
    "man city": "Manchester City",
    "manchester city": "Manchester City",
    "real madrid": "Real Madrid",
    "barcelona": "Barcelona",
    "fc barcelona": "Barcelona",
    "bayern": "Bayern Munich",
    "bayern munich": "Bayern Munich",
}

# Position labels that follow names (fixed values).
POSITION_LABELS = [
    "Goalkeeper", "Centre-Back", "Left-Back", "Right-Back", "Defensive Midfield", "Central Midfield", "Attacking Midfield",
    "Left Winger", "Right Winger", "Right Midfield", "Left Midfield", "Second Striker", "Centre-Forward",
]

# Season weights of the match matrix, by tournament (fixed values).
MATRIX_SEASONS = {
    "wc2018": {"2016-2017": 0.6, "2017-2018": 1.0},
    "euro2020": {"2018-2019": 0.5, "2019-2020": 0.75, "2020-2021": 1.0},
    "wc2022": {"2018-2019": 0.4, "2019-2020": 0.6, "2020-2021": 0.8, "2021-2022": 1.0},
    "wc2026": {"2022-2023": 0.3, "2023-2024": 0.5, "2024-2025": 0.8, "2025-2026": 1.0},
}

# Season weights of a single team's profile, by tournament, and of a club's (fixed values).
PROFILE_SEASONS = {
    "wc2018": {"2016-2017": 0.6, "2017-2018": 1.0},
    "euro2020": {"2018-2019": 0.5, "2019-2020": 0.75, "2020-2021": 1.0},
    "wc2022": {"2020-2021": 0.6, "2021-2022": 1.0},
    "wc2026": {"2022-2023": 0.3, "2023-2024": 0.5, "2024-2025": 0.8, "2025-2026": 1.0},
}
CLUB_SEASONS = {"2021-2022": 0.15, "2022-2023": 0.25, "2023-2024": 0.45, "2024-2025": 1.0}

# Where the ratings before a tournament come from: a year of the history, or a snapshot file (fixed values).
SNAPSHOTS: dict[str, int | str] = {"wc2018": 2017, "euro2020": 2020, "wc2022": 2021, "wc2026": "snapshot"}


def latest_season(seasons: dict[str, float]) -> str:
    """The season of the highest weight, the last of equals."""
    return max(seasons, key=lambda s: (seasons[s], s))
