"""Small fixed tables: address blocks, callsign prefixes, ship types. All are far below any broadcast limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# First and last address of each block (hexadecimal) and its country.
COUNTRY_BLOCKS = """
004000 0043FF Zimbabwe
006000 006FFF Mozambique
008000 00FFFF South Africa
010000 017FFF Egypt
018000 01FFFF Libya
020000 027FFF Morocco
028000 02FFFF Tunisia
030000 0303FF Botswana
032000 032FFF Burundi
034000 034FFF Cameroon
038000 038FFF Congo
03E000 03EFFF Ivory Coast
040000 040FFF DR Congo
042000 042FFF Ethiopia
044000 044FFF Equatorial Guinea
046000 046FFF Gabon
048000 048FFF Ghana
04A000 04AFFF Guinea
04C000 04CFFF Kenya
050000 050FFF Liberia
054000 054FFF Madagascar
058000 058FFF Malawi
05A000 05AFFF Mali
05C000 05CFFF Mauritania
060000 060FFF Niger
062000 062FFF Nigeria
064000 064FFF Uganda
068000 068FFF Senegal
06A000 06AFFF Sierra Leone
06C000 06CFFF Somalia
070000 070FFF Sudan
074000 074FFF Tanzania
078000 078FFF Chad
07C000 07CFFF Zambia
080000 080FFF Comoros
084000 084FFF Djibouti
088000 088FFF Eritrea
08A000 08AFFF Gambia
08C000 08CFFF Burkina Faso
098000 098FFF Lesotho
09A000 09AFFF Namibia
0A0000 0A7FFF Algeria
0C0000 0C4FFF Angola
0C8000 0C8FFF Rwanda
0CA000 0CAFFF Togo
0CC000 0CCFFF Benin
0D0000 0D7FFF Bahamas
0D8000 0DFFFF Barbados
0E0000 0E3FFF Belize
0E4000 0E7FFF Colombia
0E8000 0EBFFF Costa Rica
0EC000 0EFFFF Cuba
0F0000 0F3FFF El Salvador
0F4000 0F7FFF Guatemala
0F8000 0FBFFF Guyana
0FC000 0FFFFF Haiti
100000 103FFF Honduras
108000 10BFFF Jamaica
110000 113FFF Nicaragua
114000 117FFF Panama
118000 11BFFF Dominican Republic
11C000 11FFFF Trinidad and Tobago
120000 123FFF Suriname
140000 143FFF Antigua and Barbuda
200000 27FFFF Unassigned
300000 33FFFF Italy
340000 37FFFF Spain
380000 3BFFFF France
3C0000 3FFFFF Germany
400000 43FFFF United Kingdom
440000 447FFF Austria
448000 44FFFF Belgium
450000 457FFF Bulgaria
458000 45FFFF Denmark
460000 467FFF Finland
468000 46FFFF Greece
470000 477FFF Hungary
478000 47FFFF Norway
480000 487FFF Netherlands
488000 48FFFF Poland
490000 497FFF Portugal
498000 49FFFF Czech Republic
4A0000 4A7FFF Romania
4A8000 4AFFFF Sweden
4B0000 4B7FFF Switzerland
4B8000 4BFFFF Turkey
4C0000 4C7FFF Yugoslavia/Serbia
4CA000 4CAFFF Cyprus
4CC000 4CCFFF Ireland
4D0000 4D03FF Iceland
500000 5003FF Sri Lanka
501000 5013FF Malaysia
508000 50FFFF Indonesia
510000 5107FF Iraq
600000 6003FF Singapore
680000 6803FF Thailand
681000 6813FF Vietnam
700000 700FFF Afghanistan
710000 717FFF Pakistan
718000 71FFFF Bangladesh
720000 727FFF Myanmar
730000 737FFF Kuwait
738000 73FFFF Laos
740000 747FFF Nepal
748000 74FFFF Oman
750000 757FFF Saudi Arabia
758000 75FFFF South Korea
760000 767FFF North Korea
768000 76FFFF Syria
770000 777FFF Taiwan
778000 77FFFF Jordan
780000 7BFFFF China
7C0000 7FFFFF Australia
800000 83FFFF India
840000 87FFFF Japan
880000 887FFF Thailand
890000 890FFF Vietnam
894000 894FFF Hong Kong
895000 8953FF Macau
896000 896FFF Cambodia
897000 8973FF Philippines
898000 898FFF Mongolia
899000 8993FF Maldives
8A0000 8A7FFF UAE
900000 9003FF Israel
A00000 AFFFFF United States
C00000 C3FFFF Canada
C80000 C87FFF New Zealand
C88000 C88FFF Fiji
E00000 E3FFFF Argentina
E40000 E7FFFF Brazil
E80000 E83FFF Chile
E84000 E87FFF Ecuador
E88000 E8BFFF Paraguay
E8C000 E8FFFF Peru
E90000 E93FFF Uruguay
E94000 E97FFF Venezuela
F00000 F07FFF ICAO (special)
F09000 F093FF ICAO (special)
"""
# The military address block and callsign prefixes.
MILITARY_FIRST, MILITARY_LAST = "ADF7C8", "AFFFFF"
MILITARY_CALLSIGNS = "RCH DUKE DOOM JAKE TOPCAT REACH EVAC TEAL SPAR SAM EXEC CRZR MOOSE CANAF ASCOT RAFR GAF URAN CNV FAF IAM SUI".split()
# Operator by callsign prefix.
AIRLINES = """
AAL American Airlines
DAL Delta Air Lines
UAL United Airlines
SWA Southwest Airlines
JBU JetBlue Airways
NKS Spirit Airlines
FFT Frontier Airlines
ASA Alaska Airlines
HAL Hawaiian Airlines
SKW SkyWest Airlines
RPA Republic Airways
ENY Envoy Air
ASH Mesa Airlines
PDT Piedmont Airlines
JIA PSA Airlines
UPS UPS
FDX FedEx
GTI Atlas Air
ABX ABX Air
ACA Air Canada
WJA WestJet
BAW British Airways
DLH Lufthansa
AFR Air France
EZY easyJet
RYR Ryanair
"""
CARGO = "UPS FDX GTI ABX CLX GEC CKS BOX".split()
# Emergency codes.
EMERGENCIES = {"7500": "Hijack", "7600": "Radio failure", "7700": "Emergency"}
# Frame length in bits by downlink format.
FRAME_BITS = {0: 56, 4: 56, 5: 56, 11: 56, 16: 112, 17: 112, 18: 112, 20: 112, 21: 112}
# First and last ship type code and label.
SHIP_TYPES = """
0 0 Not Available
1 19 Reserved
20 29 WIG
30 30 Fishing
31 32 Towing
33 33 Dredging
34 34 Diving Ops
35 35 Military Ops
36 36 Sailing
37 37 Pleasure Craft
38 39 Reserved
40 49 High Speed Craft
50 50 Pilot
51 51 Search and Rescue
52 52 Tug
53 53 Port Tender
54 54 Anti-Pollution
55 55 Law Enforcement
56 59 Other (Special)
60 69 Passenger
70 79 Cargo
80 89 Tanker
90 99 Other
"""


def rows(table: str, fields: int) -> list[list[str]]:
    return [line.split(" ", fields - 1) for line in table.strip().splitlines()]


def country_blocks(spark: SparkSession) -> DataFrame:
    data = [(int(a, 16), int(b, 16), c) for a, b, c in rows(COUNTRY_BLOCKS, 3)]
    return spark.createDataFrame(data, "first long, last long, country string")


def ship_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(int(a), int(b), c) for a, b, c in rows(SHIP_TYPES, 3)], "first int, last int, label string")


def airlines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows(AIRLINES, 2)], "prefix string, operator string")


def values_sql(name: str, columns: str, data: list[tuple]) -> str:
    """A named table of literals for a WITH clause."""
    quote = lambda v: str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in data) + ")"
