"""The signature rules of the license scan: patterns over words joined by one space.

A family has a label, a pattern for its names, its tag and its address. Each family gives up to
five signatures: the tag after an SPDX mark, a notice that something is licensed under the name, a
metadata field, the address, and the bare name. License texts and marks of ownership are
signatures of their own. ``gate`` lists groups of words; a signature is tried only on texts that
hold a word of each group, so every match of the pattern must hold one too.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """``kind`` gives the priority; ``pattern`` matches whole words of the joined text. Its group
    ``at``, if it has one, is the interval of the detection: what leads up to a name takes no part
    in containment, so that one notice may name two licenses."""

    label: str
    kind: str
    pattern: str
    gate: tuple[tuple[str, ...], ...]


class Family(NamedTuple):
    label: str
    name: str
    gate: tuple[tuple[str, ...], ...]
    tag: str = ""
    address: str = ""
    address_gate: tuple[str, ...] = ()


# Kinds in order of priority, and how sure a detection of the kind is by itself.
KINDS = {"base": 0.95, "text": 0.98, "tag": 0.97, "notice": 0.9, "field": 0.85, "address": 0.8, "name": 0.6, "mark": 0.3}

WORD = "[^ ]++"
LICENSE = ("license", "licence", "licenses", "licences")
LIC = "licen[sc]e"
VERSION = "(?:version |v )?"

# Phrases and labels that any scan of a text reports; none of them is ever suppressed.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

GNU = ("gnu", "general")
FAMILIES = (
    Family("mit", f"(?:mit|expat)(?: x11)?(?: style)? {LIC}|x11 mit {LIC}", (LICENSE, ("mit", "expat")), "mit",
           "opensource org licenses? mit", ("opensource",)),
    Family("mit-0", f"mit(?: no attribution {LIC}| 0 {LIC})", (("attribution", "0"), ("mit",)), "mit 0", "opensource org licenses? mit 0", ("opensource",)),
    Family("apache-2", f"apache(?: software)? {LIC}(?: {VERSION}2(?: 0)?| v2)|apache(?: v2| 2 0)(?: {LIC})?|asl 2 0", (("apache", "asl"),),
           "apache 2 0", "apache org licenses license 2 0", ("apache",)),
    Family("apache-1.1", f"apache(?: software)? {LIC} {VERSION}1 1", (("apache",),), "apache 1 1", "apache org licenses license 1 1", ("apache",)),
    Family("apache-1.0", f"apache(?: software)? {LIC} {VERSION}1 0", (("apache",),), "apache 1 0", "apache org licenses license 1 0", ("apache",)),
    Family("apache", f"apache(?: software)? {LIC}", (("apache",), LICENSE)),
    Family("gpl-3.0-or-later", f"(?:gnu )?(?:general public {LIC}|gpl) {VERSION}(?:v?3)(?: 0)? or(?: at your option)?(?: any)? (?:later|newer|greater)(?: version)?|gplv3 (?:or later|plus)",
           (("later", "newer", "greater", "plus"), ("gpl", "gplv3", "general")), "gpl 3 0 (?:or later|plus)"),
    Family("gpl-3.0", f"(?:gnu )?(?:general public {LIC}|gpl) {VERSION}v?3(?: 0)?|gplv3", (("gpl", "gplv3", "general"),),
           "gpl 3 0(?: only)?", "gnu org licenses gpl 3 0", ("gnu",)),
    Family("gpl-2.0-or-later", f"(?:gnu )?(?:general public {LIC}|gpl) {VERSION}(?:v?2)(?: 0)? or(?: at your option)?(?: any)? (?:later|newer|greater)(?: version)?|gplv2 (?:or later|plus)",
           (("later", "newer", "greater", "plus"), ("gpl", "gplv2", "general")), "gpl 2 0 (?:or later|plus)"),
    Family("gpl-2.0", f"(?:gnu )?(?:general public {LIC}|gpl) {VERSION}v?2(?: 0)?|gplv2", (("gpl", "gplv2", "general"),),
           "gpl 2 0(?: only)?", "gnu org licenses (?:old licenses )?gpl 2 0", ("gnu",)),
    Family("gpl-1.0", f"(?:gnu )?(?:general public {LIC}|gpl) {VERSION}v?1(?: 0)?", (("gpl", "general"),), "gpl 1 0(?: only| or later)?",
           "gnu org licenses old licenses gpl 1 0", ("gnu",)),
    Family("gpl", f"(?:gnu )?general public {LIC}|gnu gpl", (GNU, ("gpl", *LICENSE)), "gpl", "gnu org (?:licenses|copyleft) gpl", ("gnu",)),
    Family("lgpl-3.0", f"(?:gnu )?(?:lesser general public {LIC}|lgpl) {VERSION}v?3(?: 0)?|lgplv3", (("lesser", "lgpl", "lgplv3"),),
           "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0", ("gnu",)),
    Family("lgpl-2.1", f"(?:gnu )?(?:lesser general public {LIC}|lgpl) {VERSION}v?2 1|lgplv2 1", (("lesser", "lgpl", "lgplv2"),),
           "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1", ("gnu",)),
    Family("lgpl-2.0", f"(?:gnu )?library general public {LIC}(?: {VERSION}2(?: 0)?)?|lgpl {VERSION}v?2 0", (("library", "lgpl"), ("lgpl", "general")),
           "lgpl 2 0(?: only| or later)?", "gnu org licenses old licenses lgpl 2 0", ("gnu",)),
    Family("lgpl", f"(?:gnu )?lesser general public {LIC}|gnu lgpl", (("lesser", "lgpl"),), "lgpl", "gnu org licenses lgpl", ("gnu",)),
    Family("agpl-3.0", f"(?:gnu )?(?:affero general public {LIC}|agpl)(?: {VERSION}v?3(?: 0)?)|agplv3", (("affero", "agpl", "agplv3"),),
           "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0", ("gnu",)),
    Family("agpl", f"(?:gnu )?affero general public {LIC}|gnu agpl", (("affero", "agpl"),), "agpl", "gnu org licenses agpl", ("gnu",)),
    Family("gfdl", f"gnu free documentation {LIC}|gfdl", (("documentation", "gfdl"),), "gfdl 1 [123](?: only| or later)?", "gnu org (?:licenses|copyleft) fdl", ("gnu",)),
    Family("bsd-4-clause", f"(?:original|old|4 clause|four clause) bsd(?: {LIC})?|bsd 4 clause(?: {LIC})?", (("bsd",),), "bsd 4 clause"),
    Family("bsd-3-clause", f"(?:new|modified|revised|3 clause|three clause) bsd(?: {LIC})?|bsd 3 clause(?: {LIC})?", (("bsd",),), "bsd 3 clause",
           "opensource org licenses? bsd 3 clause", ("opensource",)),
    Family("bsd-2-clause", f"(?:simplified|freebsd|2 clause|two clause) bsd(?: {LIC})?|bsd 2 clause(?: {LIC})?|freebsd {LIC}", (("bsd", "freebsd"),), "bsd 2 clause",
           "opensource org licenses? bsd 2 clause", ("opensource",)),
    Family("0bsd", f"(?:zero|0) clause bsd(?: {LIC})?|bsd zero clause(?: {LIC})?", (("bsd",),), "0bsd"),
    Family("bsd", f"(?:berkeley software distribution|bsd)(?: style| type)? {LIC}", (("bsd", "berkeley"), LICENSE), "bsd",
           "opensource org licenses? bsd license", ("opensource",)),
    Family("isc", f"isc {LIC}", (("isc",),), "isc", "opensource org licenses? isc", ("opensource",)),
    Family("mpl-2.0", f"mozilla public {LIC} {VERSION}2(?: 0)?|mpl {VERSION}2 0|mplv2", (("mozilla", "mpl", "mplv2"),), "mpl 2 0", "mozilla org (?:en us )?mpl 2 0", ("mozilla",)),
    Family("mpl-1.1", f"mozilla public {LIC} {VERSION}1 1|mpl 1 1", (("mozilla", "mpl"),), "mpl 1 1", "mozilla org mpl mpl 1 1", ("mozilla",)),
    Family("mpl", f"mozilla public {LIC}", (("mozilla",),), "", "mozilla org mpl", ("mozilla",)),
    Family("epl-2.0", f"eclipse public {LIC} {VERSION}2(?: 0)?|epl 2 0", (("eclipse", "epl"),), "epl 2 0", "eclipse org legal epl (?:2 0|v20)", ("eclipse",)),
    Family("epl-1.0", f"eclipse public {LIC} {VERSION}1(?: 0)?|epl 1 0", (("eclipse", "epl"),), "epl 1 0", "eclipse org legal epl v10", ("eclipse",)),
    Family("epl", f"eclipse public {LIC}", (("eclipse",),)),
    Family("edl-1.0", f"eclipse distribution {LIC}(?: {VERSION}1(?: 0)?)?", (("eclipse",),), "", "eclipse org (?:org documents|legal) edl v10", ("eclipse",)),
    Family("cddl-1.0", f"common development and distribution {LIC}(?: {VERSION}1(?: 0)?)?|cddl(?: {VERSION}1 0)?", (("cddl", "development"),), "cddl 1 0", "opensource org licenses? cddl 1 0", ("opensource",)),
    Family("cddl-1.1", f"(?:common development and distribution {LIC}|cddl) {VERSION}1 1", (("cddl", "development"),), "cddl 1 1"),
    Family("cpl-1.0", f"common public {LIC}(?: {VERSION}1(?: 0)?)?", (("common",), LICENSE), "cpl 1 0", "opensource org licenses? cpl1 0", ("opensource",)),
    Family("ipl-1.0", f"ibm public {LIC}(?: {VERSION}1(?: 0)?)?", (("ibm",),), "ipl 1 0"),
    Family("eupl-1.2", f"european union public licen[sc]e(?: {VERSION}1 2)?|eupl(?: {VERSION}1 2)?", (("european", "eupl"),), "eupl 1 2", "joinup ec europa eu(?: collection)? eupl", ("joinup",)),
    Family("eupl-1.1", f"(?:european union public licen[sc]e|eupl) {VERSION}1 1", (("european", "eupl"),), "eupl 1 1"),
    Family("artistic-2.0", f"artistic {LIC} {VERSION}2(?: 0)?", (("artistic",),), "artistic 2 0", "opensource org licenses? artistic(?: license)? 2 0", ("opensource",)),
    Family("artistic-1.0", f"artistic {LIC}(?: {VERSION}1(?: 0)?)?", (("artistic",),), "artistic 1 0(?: perl| cl8)?"),
    Family("perl", f"same terms as perl(?: itself)?", (("perl",),)),
    Family("boost-1.0", f"boost software {LIC}(?: {VERSION}1(?: 0)?)?", (("boost",),), "bsl 1 0", "boost org license 1 0", ("boost",)),
    Family("busl-1.1", f"business source {LIC}(?: {VERSION}1 1)?", (("business",), LICENSE), "busl 1 1", "mariadb com bsl11", ("mariadb",)),
    Family("elastic-2.0", f"elastic {LIC}(?: {VERSION}2(?: 0)?)?", (("elastic",), LICENSE), "elastic 2 0", "elastic co licensing elastic license", ("elastic",)),
    Family("sspl-1.0", f"server side public {LIC}(?: {VERSION}1(?: 0)?)?|sspl(?: {VERSION}1)?", (("sspl", "server"),), "sspl 1 0", "mongodb com licensing server side public license", ("mongodb",)),
    Family("zlib", f"zlib(?: libpng)? {LIC}", (("zlib",),), "zlib", "opensource org licenses? zlib", ("opensource",)),
    Family("libpng", f"(?:png reference library|libpng) {LIC}", (("png", "libpng"),), "libpng(?: 2 0)?"),
    Family("unlicense", "(?:the )?unlicense", (("unlicense",),), "unlicense", "unlicense org", ("unlicense",)),
    Family("wtfpl", f"do what the f(?:uck)? you want to public {LIC}|wtfpl", (("wtfpl", "want"),), "wtfpl", "wtfpl net", ("wtfpl",)),
    Family("python-2.0", f"(?:psf|python software foundation|python) {LIC}(?: {VERSION}2(?: 0)?)?", (("psf", "python"), LICENSE), "(?:psf|python) 2 0", "docs python org 3 license html", ("python",)),
    Family("php-3.01", f"php {LIC}(?: {VERSION}3 01)?", (("php",), LICENSE), "php 3 01", "php net license", ("php",)),
    Family("ruby", f"ruby s {LIC}|ruby {LIC}", (("ruby",), LICENSE), "ruby"),
    Family("postgresql", f"postgresql {LIC}", (("postgresql",), LICENSE), "postgresql", "opensource org licenses? postgresql", ("opensource",)),
    Family("openssl", f"openssl(?: and ssleay)? {LIC}", (("openssl",), LICENSE), "openssl"),
    Family("curl", f"curl {LIC}", (("curl",), LICENSE), "curl", "curl se docs copyright", ("curl",)),
    Family("ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LIC}", (("ncsa",),), "ncsa"),
    Family("ms-pl", f"(?:microsoft|ms) public {LIC}", (("microsoft", "ms"), LICENSE), "ms pl"),
    Family("ms-rl", f"(?:microsoft|ms) reciprocal {LIC}", (("microsoft", "ms"), LICENSE), "ms rl"),
    Family("afl-3.0", f"academic free {LIC}(?: {VERSION}[123](?: [01])?)?", (("academic",), LICENSE), "afl 3 0"),
    Family("osl-3.0", f"open software {LIC}(?: {VERSION}3(?: 0)?)?", (("open",), LICENSE, ("software",)), "osl 3 0"),
    Family("ofl-1.1", f"(?:sil )?open font {LIC}(?: {VERSION}1 1)?|sil ofl", (("font", "ofl"),), "ofl 1 1", "scripts sil org ofl", ("sil",)),
    Family("odbl-1.0", f"open (?:data commons )?(?:open )?database {LIC}(?: {VERSION}1(?: 0)?)?|odbl", (("database", "odbl"),), "odbl 1 0", "opendatacommons org licenses odbl", ("opendatacommons",)),
    Family("odc-by-1.0", f"open data commons attribution {LIC}(?: {VERSION}1(?: 0)?)?|odc by", (("odc", "commons"),), "odc by 1 0", "opendatacommons org licenses by", ("opendatacommons",)),
    Family("pddl-1.0", f"(?:open data commons )?public domain dedication and {LIC}|pddl", (("pddl", "dedication"),), "pddl 1 0", "opendatacommons org licenses pddl", ("opendatacommons",)),
    Family("ogl-uk-3.0", f"open government {LIC}(?: {VERSION}3(?: 0)?)?", (("government",), LICENSE), "ogl uk 3 0", "nationalarchives gov uk doc open government licence", ("nationalarchives",)),
    Family("etalab-2.0", "(?:licence ouverte|open licence) (?:etalab )?(?:version )?2 0|etalab 2 0", (("etalab", "ouverte", "licence"),), "etalab 2 0"),
    Family("cecill-2.1", "cecill(?: (?:version )?2 1)?", (("cecill",),), "cecill 2 1", "cecill info", ("cecill",)),
    Family("vim", f"vim {LIC}", (("vim",), LICENSE), "vim"),
    Family("tcl", f"tcl(?: tk)? {LIC}", (("tcl",), LICENSE), "tcl"),
    Family("w3c", f"w3c software(?: notice and)? {LIC}", (("w3c",),), "w3c", "w3 org consortium legal", ("w3",)),
    Family("upl-1.0", f"universal permissive {LIC}(?: {VERSION}1(?: 0)?)?", (("permissive",), LICENSE), "upl 1 0"),
    Family("mulan-2.0", f"mulan(?: permissive software)? {LIC}(?: {VERSION}2)?|mulan psl(?: v2)?", (("mulan",),), "mulanpsl 2 0", "license coscl org cn mulanpsl2", ("coscl",)),
    Family("ecl-2.0", f"educational community {LIC}(?: {VERSION}2(?: 0)?)?", (("educational",), LICENSE), "ecl 2 0"),
    Family("lppl-1.3c", f"latex project public {LIC}(?: {VERSION}1 3[ac]?)?|lppl", (("latex", "lppl"),), "lppl 1 3c", "latex project org lppl", ("latex",)),
    Family("qpl-1.0", f"q public {LIC}(?: {VERSION}1(?: 0)?)?", (("q",), LICENSE), "qpl 1 0"),
    Family("blueoak-1.0.0", f"blue oak model {LIC}(?: 1 0 0)?", (("oak",),), "blueoak 1 0 0", "blueoakcouncil org license 1 0 0", ("blueoakcouncil",)),
    Family("openrail", f"(?:bigscience |creativeml )?open ?rail(?: m)? {LIC}|openrail(?: m)?", (("openrail", "rail"),)),
    Family("cc0-1.0", "cc0(?: 1 0)?(?: universal)?|creative commons zero|cc zero", (("cc0", "zero"),), "cc0 1 0", "creativecommons org publicdomain zero 1 0", ("creativecommons",)),
    Family("cc-pd", "(?:creative commons )?public domain mark(?: 1 0)?", (("domain",),), "", "creativecommons org publicdomain mark 1 0", ("creativecommons",)),
)

# Words of the Creative Commons conditions, and how they are spelled out.
CONDITIONS = {
    "by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative|ative works|s|atives)",
    "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative|ative works|s|atives)",
}


def _commons() -> list[Family]:
    """Each set of conditions, of any version."""
    number = "(?: (?:version |v )?[1-4] [05])?"
    return [
        Family(
            f"cc-{short.replace(' ', '-')}",
            f"(?:cc|creative commons) {short}{number}|creative commons {long}{number}",
            (("cc", "commons"), ("by", "attribution")), f"cc {short} [1-4] [05]",
            f"creativecommons org licenses {short}(?: [1-4] [05])?", ("creativecommons",),
        ) for short, long in CONDITIONS.items()
    ]


# Sentences of license texts that no other license has.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "merchantability"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided", "hereby"),
    ("0bsd", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)", "hereby"),
    ("apache-2", "you may not use this file except in compliance with the license", "compliance"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable"),
    ("apache-2", "apache license version 2 0 january 2004", "apache"),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", "irrevocable"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("bsd-3-clause", f"neither the name of (?:{WORD} ){{1,8}}?nor the names of its contributors may be used to endorse or promote products", "endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", "advertising"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", "gnu"),
    ("gpl-2.0", "gnu general public license version 2 june 1991", "gnu"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|software|file|library)", "received"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", "lesser"),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", "lesser"),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", "affero"),
    ("agpl", "if you modify the program your modified version must prominently offer all users interacting with it remotely", "remotely"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0", "eclipse"),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "eclipse"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", "development"),
    ("boost-1.0", "boost software license version 1 0 august 17th 2003", "boost"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("wtfpl", "you just do what the fuck you want to", "want"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", "deed"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "establishes"),
    ("python-2.0", "this license agreement is between the python software foundation", "python"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", "hereby"),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission", "eupl"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "licensor"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", "hosted"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized"),
    ("proprietary", "no part of this (?:publication|book|work|document) may be reproduced", "reproduced"),
    ("proprietary", "this (?:software|document|file) (?:is|contains) (?:the )?(?:proprietary|confidential)(?: and (?:confidential|proprietary))?(?: information)?", "proprietary confidential"),
    ("public-domain", "(?:released|dedicated|placed|put) (?:in|into|to) the public domain", "domain"),
    ("public-domain", "(?:this|the) (?:work|file|text|software|code|document|image) is in the public domain", "domain"),
    ("public-domain", "no (?:known )?copyright restrictions", "restrictions"),
)

# Signs of ownership that name no license.
MARKS = (
    ("all-rights-reserved", "all rights reserved", "reserved"),
    ("all-rights-reserved", "tous droits réservés", "réservés"),
    ("all-rights-reserved", "alle rechte vorbehalten", "vorbehalten"),
    ("all-rights-reserved", "todos los derechos reservados", "reservados"),
    ("copyright-notice", f"copyright (?:c )?(?:by )?(?:19|20)[0-9][0-9]", "copyright"),
    ("copyright-notice", f"(?:19|20)[0-9][0-9] copyright", "copyright"),
    ("copyright-notice", f"copyright (?:c )?by {WORD}", "copyright"),
    ("license-file", f"see (?:the )?(?:accompanying )?{LIC}(?: txt| md)?(?: file)? for (?:more )?(?:details|information|the full)", "see"),
    ("license-file", f"(?:license|licence|copying) file (?:in the root|distributed with|at the top)", "file"),
    ("non-commercial", "(?:for )?non ?commercial (?:use|purposes) only", "commercial noncommercial"),
    ("research-only", "(?:for )?(?:academic|research) (?:use|purposes) only", "academic research"),
    ("personal-use", "(?:for )?personal use only", "personal"),
)

GRANTED = ("licensed", "licenced", "released", "distributed", "available", "provided", "published", "covered", "governed",
           "offered", "redistributed", "shared", "redistribute", "terms", "subject", "use", "used")


def _of_family(f: Family) -> list[Rule]:
    name = f"(?:{f.name})"
    rules = [
        Rule(f.label, "notice", f"(?:{'|'.join(GRANTED)})(?: {WORD}){{0,3}}? (?:under|by|of|to|with)(?: {WORD}){{0,5}}? (?P<at>{name})", (*f.gate, GRANTED)),
        Rule(f.label, "name", name, f.gate),
    ]
    if f.tag:
        rules.append(Rule(f.label, "tag", f"spdx license identifier(?: {WORD}){{0,6}}? (?P<at>{f.tag})", (("spdx",),)))
        rules.append(Rule(f.label, "field", f"{LIC}s? (?:osi approved )?(?:{f.tag})", (LICENSE, (f.tag.split(" ")[0],)) if f.tag[0] != "(" else (LICENSE,)))
    if f.address:
        rules.append(Rule(f.label, "address", f"(?:{f.address})", (f.address_gate,)))
    return rules


def signatures() -> list[Rule]:
    """All rules in order: by kind, then as listed."""
    rules = [Rule(label, "base", phrase, (tuple(phrase.split(" ")[1:2]), tuple(phrase.split(" ")[2:3]))) for phrase, label in BASE]
    rules += [Rule(label, "text", pattern, (tuple(gate.split(" ")),)) for label, pattern, gate in TEXTS]
    rules += [Rule(label, "mark", pattern, (tuple(gate.split(" ")),)) for label, pattern, gate in MARKS]
    for family in (*FAMILIES, *_commons()):
        rules += _of_family(family)
    order = list(KINDS)
    return sorted(rules, key=lambda r: order.index(r.kind))
