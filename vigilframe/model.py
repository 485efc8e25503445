"""Fixed values of the data model: ranks, points, lanes, retention days, rules."""

from __future__ import annotations

# Each list in falling order, each table as the data model has it.
SEVERITIES = ("Extreme", "Severe", "Moderate", "Minor", "Unknown")
URGENCIES = ("Immediate", "Expected", "Future", "Past", "Unknown")
CERTAINTIES = ("Observed", "Likely", "Possible", "Unlikely", "Unknown")
SEVERITY_POINTS = {"Extreme": 40, "Severe": 30, "Moderate": 20, "Minor": 10, "Unknown": 0}
URGENCY_POINTS = {"Immediate": 20, "Expected": 15, "Future": 8, "Past": 0, "Unknown": 0}
TERMINAL = ("cancelled", "ended")
#: kind -> (lane, days kept)
TAXONOMY = {
    "earthquake": ("hazards", 30),
    "weather_alert": ("hazards", 14),
    "tropical_cyclone": ("hazards", 30),
    "tsunami": ("hazards", 30),
    "volcano": ("hazards", 90),
    "wildfire": ("hazards", 14),
    "natural_event": ("hazards", 30),
    "disaster": ("hazards", 30),
    "disaster_declaration": ("hazards", 365),
    "conflict_report": ("world_context", 14),
    "humanitarian_report": ("world_context", 30),
    "aircraft": ("mobility", 1),
    "aviation_hazard": ("mobility", 14),
    "marine_observation": ("mobility", 7),
    "water_level": ("mobility", 30),
    "fireball": ("science", 365),
    "space_weather": ("science", 30),
    "orbital_position": ("science", 1),
    "market_snapshot": ("markets", 7),
    "technology_activity": ("optional_signal", 3),
    "news_item": ("world_context", 7),
}
MEDIA_KINDS = ("news_item", "conflict_report", "humanitarian_report")
NAMED_HAZARD_KINDS = ("wildfire", "volcano", "natural_event", "disaster")
#: Correlation thresholds, hours, kilometres, likeness.
RULES = {
    "earthquake": (0.25, 150.0),
    "tropical_cyclone": (168.0, None),
    "tsunami_relation": (6.0, 1000.0),
    "named_hazard": (48.0, 250.0),
    "media": (36.0, 0.72),
    "coverage": (36.0, 0.5),
    "aviation_ash": (48.0, 750.0),
    "aviation_weather": (6.0, 400.0),
}
DECLARATION_PADDING_HOURS, DECLARATION_OPEN_DAYS = 72, 30
STOP_WORDS = ("a", "an", "and", "at", "for", "in", "of", "on", "the", "to", "update")
AREA_WORDS = ("county", "parish", "borough", "census", "area", "municipality", "city", "and", "of")
EARTH_KM = 6371.0088
#: Fixed values. A stem with a word boundary after it matches the stem alone.
CONFLICT_WORDS = (
    r"\b(war|conflict|attack|strike|missile|drone|troops?|forces|battle|ceasefire|truce|killed|wounded|hostage|invasion|offensive|fighting|"
    r"clash|airstrike|sanction|military|army|navy|rebels?|junta|insurgen|genocide|atrocit|massacre|coup|protest|riot)\b"
)
FILTER_KINDS = {
    "natural": ("earthquake", "tropical_cyclone", "tsunami", "volcano", "wildfire", "natural_event", "disaster", "disaster_declaration"),
    "weather": ("weather_alert",),
    "conflict": ("conflict_report", "humanitarian_report", "news_item"),
    "mobility": ("aircraft", "aviation_hazard", "marine_observation", "water_level", "tropical_cyclone", "tsunami"),
    "signals": ("fireball", "space_weather", "orbital_position", "market_snapshot", "technology_activity", "unknown"),
}
#: Which kinds an arriving observation of a kind is held against, to find relations. Reports look at all kinds but reports.
ROUTES = {
    "tsunami": ("earthquake", "disaster_declaration"),
    "earthquake": ("tsunami", "disaster_declaration"),
    "aviation_hazard": ("weather_alert", "volcano"),
    "weather_alert": ("aviation_hazard", "disaster_declaration"),
    "volcano": ("aviation_hazard", "disaster_declaration"),
    "disaster_declaration": ("earthquake", "tropical_cyclone", "tsunami", "volcano", "wildfire", "weather_alert", "natural_event", "disaster"),
    "tropical_cyclone": ("disaster_declaration",),
    "wildfire": ("disaster_declaration",),
    "natural_event": ("disaster_declaration",),
    "disaster": ("disaster_declaration",),
}
#: Words in a declaration's incident type, and the kinds they allow; the first group that matches holds.
DECLARED_TYPES = (
    (("EARTHQUAKE",), ("earthquake",)),
    (("HURRICANE", "TROPICAL STORM", "TYPHOON"), ("tropical_cyclone",)),
    (("TSUNAMI",), ("tsunami",)),
    (("VOLCAN",), ("volcano",)),
    (("FIRE",), ("wildfire",)),
    (("SEVERE STORM", "FLOOD", "TORNADO", "SNOW", "FREEZ", "DROUGHT"), ("weather_alert", "natural_event", "disaster")),
)
#: Theatres and the words that place a text in one; a text is in the worldwide one anyway.
THEATRES = {
    "ukr": "ukrain|russia|kyiv|kharkiv|donetsk|kherson|moscow|belgorod|kursk",
    "isr": "israel|gaza|lebanon|hezbollah|west bank|jerusalem|rafah|tel aviv|hamas|idf",
    "sdn": "sudan|khartoum|darfur|ethiopia|tigray|somalia|south sudan|rsf|eritrea",
    "tw": "taiwan|taipei|china|beijing|south china sea|spratly|paracel|pla|prc",
    "sahel": "mali|burkina|niger|sahel|nigeria|chad|boko haram|jnim",
    "mex": "mexic|border|cartel|sinaloa|jalisco|cbp|migrant|tijuana|el paso|rio grande",
    "kor": "korea|pyongyang|seoul|dprk|kim jong",
}
#: Conflict zones and the words that name them.
ZONES = {
    "Ukraine": "ukrain|kyiv|donetsk|kharkiv|odesa|mariupol|kherson|zaporizh",
    "Russia": "russia|moscow|kremlin|kursk|belgorod",
    "Gaza": "gaza|rafah|khan younis",
    "Israel": "israel|tel aviv|jerusalem|idf",
    "Lebanon": "lebanon|beirut|hezbollah|south lebanon",
    "West Bank": "west bank|ramallah|jenin|nablus|palestinian",
    "Yemen": "yemen|sanaa|houthi|aden",
    "Sudan": "sudan|khartoum|darfur| rsf|sudanese",
    "South Sudan": "south sudan|juba",
    "Ethiopia": "ethiopia|amhara|tigray|oromia",
    "Myanmar": "myanmar|burma|rohingya|junta",
    "Syria": "syria|damascus|aleppo|idlib",
    "Iran": "iran|tehran|iranian",
    "Iraq": "iraq|baghdad|iraqi",
    "Afghanistan": "afghanistan|kabul|taliban|afghan",
    "Pakistan": "pakistan|islamabad|balochistan|khyber",
    "DR Congo": "congo|drc|goma|kinshasa|m23",
    "Mozambique": "mozambique|cabo delgado",
    "Haiti": "haiti|port-au-prince",
    "Somalia": "somalia|mogadishu|al-shabaab|shabaab",
    "Mali": "mali|bamako",
    "Burkina Faso": "burkina faso|ouagadougou",
    "Niger": "niger",
    "Sahel": "sahel",
    "Nigeria": "nigeria|boko haram|abuja",
    "Taiwan": "taiwan|taipei",
    "South China Sea": "south china sea|spratly|paracel",
    "China": " china |beijing",
    "North Korea": "north korea|pyongyang|dprk|kim jong",
    "Venezuela": "venezuela|caracas|maduro",
    "Colombia": "colombia|bogota",
    "Mexico": "mexico|cartel|sinaloa|jalisco",
    "Armenia": "armenia|yerevan|nagorno",
    "Azerbaijan": "azerbaijan|baku",
    "Georgia": "georgia (country)|tbilisi",
    "Kosovo": "kosovo|serbia|belgrade",
    "Cyprus": "cyprus",
    "Libya": "libya|tripoli|benghazi",
    "Tunisia": "tunisia|tunis",
    "Egypt": "egypt|cairo|sinai",
    "Cameroon": "cameroon|anglophone",
    "Central African Republic": "central african|bangui| car ",
    "Ecuador": "ecuador|guayaquil",
    "India": "india|kashmir|manipur",
}
