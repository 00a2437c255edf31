"""Explicit schemas of the engine's tables and payloads; production reads infer nothing."""

from __future__ import annotations

# Columns of the tables, in table order (fixed values).
PLAYERS = """internal_player_id string not null, full_name string not null, full_name_ascii string not null, display_name string,
    dob date, height_cm double, weight_kg double, position string, current_club string, league_tier int"""
LEAGUE_STATS = """id long, internal_player_id string not null, season string, as_of_date date not null, xg double, goals int, assists int,
    passes_completed int, passes_attempted int, interceptions int, tackles_won int, minutes_played int"""
# Event metrics of a player in a competition (fixed values).
EVENT_METRICS = [
    "xg", "goals", "shots", "shots_on_target", "passes_completed", "passes_attempted", "key_passes", "through_balls", "crosses",
    "progressive_passes", "dribble_attempts", "dribble_success", "carries_count", "progressive_carry_distance", "interceptions",
    "blocks", "clearances", "aerial_duels_won", "aerial_duels_lost", "ball_recoveries", "fouls_committed", "fouls_won",
    "tackle_attempts", "tackles_won", "pressures", "counter_pressures", "actions_under_pressure", "yellow_cards", "red_cards", "goalkeeper_saves",
]
REAL_METRICS = {"xg", "progressive_carry_distance"}
NATIONAL_STATS = (
    "id long, internal_player_id string not null, competition string, as_of_date date not null, "
    + ", ".join(f"{m} {'double' if m in REAL_METRICS else 'int'}" + (", assists int" if m == "goals" else "") for m in EVENT_METRICS)
    + ", caps int, minutes_played int, is_starter int"
)
MATCH_EVENTS = "id long, match_id string, event_timestamp timestamp_ntz, match_minute int, event_type string, formation string, player_id string, detail string"
TABLES = {"players": PLAYERS, "player_stats_league": LEAGUE_STATS, "player_stats_national": NATIONAL_STATS, "match_events": MATCH_EVENTS}

# Columns of feeds and files (fixed values).
MATCHES = "match_id string, home_team string, away_team string, home_score int, away_score int, competition_stage string"
EVENTS = """match_id string, player string, team string, type string, period int, location array<double>, shot_statsbomb_xg double,
    shot_outcome string, pass_outcome string, pass_shot_assist boolean, pass_through_ball boolean, pass_type string, pass_cross boolean,
    pass_length double, pass_end_location array<double>, dribble_outcome string, carry_end_location array<double>, duel_type string,
    duel_outcome string, foul_committed_card string, bad_behaviour_card string, counterpress boolean, under_pressure boolean,
    goalkeeper_outcome string,
    tactics struct<lineup:array<struct<player:struct<id:long,name:string>,position:struct<name:string>,jersey_number:int>>>"""
LINEUPS = "match_id string, team string, player_name string, player_nickname string, positions array<struct<`from`:string,`to`:string,position:string>>"
RAW_ODDS = """scraped_date string, match_date string, match_link string, home_team string, away_team string, league_name string,
    home_score string, away_score string, partial_results string, venue string, venue_town string, venue_country string, `1x2_market` string"""
ODDS = """tournament string, home_team string, away_team string, home_key string, away_key string, match_date timestamp, odds_home double,
    odds_draw double, odds_away double, prob_home double, prob_draw double, prob_away double, odds_source string, bookmaker string"""
ELO_SNAPSHOT = "teams map<string,struct<elo:double,rank:int,confederation:string>>"
ELO_HISTORY = "year int, team string, rating double, rank int"
SCHEDULE = """groups map<string,array<string>>, group_stage_matches array<struct<matchday:int,date:string,`group`:string,home:string,away:string,venue:string,kickoff_et:string>>"""
ROSTERS = "map<string,array<struct<player_id:string,name:string,club:string,position:string,match_status:string,matched_to:string,score:int>>>"
CAREERS = "array<struct<name:string,caps:int,goals:int,apps:int>>"
DOMESTIC = "Date string, HomeTeam string, AwayTeam string, FTHG string, FTAG string"
