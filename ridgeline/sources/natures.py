"""Kinds of supports in the French register of radio sites (survey JN12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: id; French name; English name; what it looks like.
TABLE = """
0;Sans nature;none given;no support recorded
4;Château d'eau - réservoir;water tower;tank on a tall stem or a walled reservoir
8;Intérieur galerie;indoor gallery;indoors, in a gallery or mall
9;Intérieur sous-terrain;indoor underground;below ground, as in a station
10;Tunnel;tunnel;along a road or rail tunnel
11;Mât béton;concrete pole;slim round pole of concrete
12;Mât métallique;steel pole;slim pole of steel
17;Bâtiment;house;low building with antennas on it
19;Monument historique;listed monument;protected building
20;Monument religieux;church;steeple or other religious building
21;Pylône;pylon;tower of unknown make
22;Pylône autoportant;pylon without guys;stands by its own legs
23;Pylône autostable;self-stable pylon;wide base and no guys
24;Pylône haubané;guyed pylon;slim and held by wires
25;Pylône treillis;lattice pylon;crossed steel bars
26;Pylône tubulaire;tube pylon;one thick steel tube
31;Silo;silo;farm or harbour silo
32;Ouvrage d'art (pont, viaduc);bridge;bridge or viaduct
33;Tour hertzienne;relay tower;large tower for radio relays
34;Dalle en béton;slab;equipment on a concrete slab
38;Immeuble;block;building of several storeys
39;Local technique;equipment room;small technical building
40;Sémaphore;semaphore;coastal watch station
41;Phare;lighthouse;lighthouse
42;Mât;pole;pole of unknown make
43;Fût;column;short column
44;Tour de contrôle;control tower;airport tower
45;Contre-poids au sol;weighted mast on ground;mast held by weights on the ground
46;Contre-poids sur shelter;weighted mast on cabin;mast held by weights on a cabin
47;Support DEFENSE;armed forces;site of the armed forces
48;pylône arbre;tree pylon;pylon dressed as a tree
49;Ouvrage de signalisation (portique routier, panneau routier);road gantry;gantry or sign across a road
50;Balise ou bouée;buoy;beacon or buoy
51;XXX;placeholder;code without meaning
52;Eolienne;wind turbine;wind turbine
55;Mobilier urbain;street furniture;bus shelter, lamp post and the like
999999999;Support non décrit;not described;support exists but isn't described
"""


def rows() -> list[tuple[int, str, str, str]]:
    out = []
    for line in TABLE.strip().splitlines():
        code, fr, en, description = line.split(";")
        out.append((int(code), fr, en, description))
    return out


def natures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "nature_id long, fr string, en string, description string")
