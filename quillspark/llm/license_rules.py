"""Signature rules of licenses, written by hand: one a line, in order of families.

A line is `label; priority; confidence; keywords; expression`. The expression is over normalised words (` w0 w1 ... `) and
begins at a word; one of the keywords, whole words, must be in the text for the rule to be tried. Priorities: 6 identifiers made for
machines, 5 wording of the license itself, 4 notices, 3 grants by name, 2 names, 1 mentions. In expressions, {lic} is the
word license, {ver} an optional version, {under} the words of a grant.
"""

from __future__ import annotations

LIC = "licen[sc]e"
VER = "(?: (?:version |v ?)?[0-9]+(?: [0-9]+)?)?"
UNDER = (
    "(?:(?:released|licen[sc]ed|licensable|distributed|redistributed|available|provided|published|offered|issued|covered) (?:[^ ]+ ){0,2}(?:under|per|by)"
    "|subject to|(?:terms|conditions|provisions) of) (?:the |a |an |terms of |conditions of |version ){0,3}"
)

TABLE = """
mit; 6; .98; mit; spdx {lic} identifier mit
mit; 5; .97; hereby; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; 5; .9; substantial; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit; 5; .8; warranty; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit; 4; .95; mit; (?:this|the) (?:software|project|code|program|library|package|work) is (?:free )?(?:and )?(?:under )?(?:the )?mit (?:{lic}|licensed)
mit; 3; .95; mit; {under}mit(?: {lic})?
mit; 3; .9; expat; {under}expat(?: {lic})?
mit; 2; .85; mit; mit(?: style| like| x11)? {lic}
mit; 2; .85; expat; expat {lic}
mit; 1; .7; mit; {lic} (?:is |type )?mit
mit-0; 6; .98; mit; spdx {lic} identifier mit 0
mit-0; 2; .9; attribution; mit no attribution(?: {lic})?
x11; 6; .98; x11; spdx {lic} identifier x11
x11; 5; .95; consortium; except as contained in this notice the name of the x consortium shall not be used
x11; 3; .9; x11; {under}x11(?: {lic})?
x11; 2; .85; x11; x11 {lic}
apache; 6; .98; apache; spdx {lic} identifier apache(?: [0-9]+){0,2}
apache; 5; .97; apache; licensed to the apache software foundation asf under one or more contributor {lic} agreements
apache; 5; .97; apache; licensed under the apache {lic} version 2 0 the {lic} you may not use this file except in compliance with the {lic}
apache; 5; .8; compliance; you may not use this file except in compliance with the {lic}
apache; 5; .8; governing; see the {lic} for the specific language governing permissions and limitations under the {lic}
apache; 4; .9; apache; (?:http|https) www apache org licenses(?: {lic} 2 0)?
apache; 3; .95; apache; {under}apache(?: software)?(?: {lic})?{ver}
apache; 2; .85; apache; apache(?: software)? {lic}{ver}
apache; 2; .85; asl; asl 2 0
apache; 1; .7; apache; {lic} (?:is |type )?apache{ver}
gpl; 6; .98; gpl; spdx {lic} identifier gpl(?: [0-9]+){0,2}(?: or later| only)?
gpl; 5; .97; redistribute; this program is free software you can redistribute it and or modify it under the terms of the gnu general public {lic}
gpl; 5; .9; hope; (?:it|this program|this library|this software) is distributed in the hope that it will be useful but without any warranty
gpl; 5; .9; gnu; you should have received a copy of the gnu general public {lic} along with this (?:program|software|file|library)
gpl; 5; .95; preamble; gnu general public {lic}(?: version [0-9])?(?: [^ ]+){0,12} preamble
gpl; 4; .95; gnu; gnu general public {lic} as published by the free software foundation(?: either)?(?: version [0-9]+)?(?: of the {lic})?(?: or at your option any later version)?
gpl; 3; .95; gpl|gplv2|gplv3; {under}(?:gnu )?gpl(?:v[23])?{ver}(?: or later)?
gpl; 3; .95; general; {under}(?:gnu )?general public(?: {lic})?{ver}
gpl; 2; .9; gnu; gnu general public {lic}{ver}
gpl; 2; .85; general; general public {lic}{ver}
gpl; 2; .85; gplv2|gplv3; gplv[23](?: or later)?
gpl; 2; .85; gpl; (?:gnu )?gpl {lic}{ver}
gpl; 2; .8; gpl; gnu gpl{ver}
gpl; 1; .7; gpl; {lic} (?:is |type )?(?:gnu )?gpl{ver}
lgpl; 6; .98; lgpl; spdx {lic} identifier lgpl(?: [0-9]+){0,2}(?: or later| only)?
lgpl; 5; .97; lesser; this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public {lic}
lgpl; 5; .9; lesser; you should have received a copy of the gnu lesser general public {lic} along with this library
lgpl; 4; .95; lesser; gnu lesser general public {lic} as published by the free software foundation
lgpl; 3; .95; lgpl; {under}(?:gnu )?lgpl{ver}
lgpl; 3; .95; lesser; {under}(?:gnu )?lesser general public(?: {lic})?{ver}
lgpl; 2; .9; lesser; (?:gnu )?lesser general public {lic}{ver}
lgpl; 2; .9; library; (?:gnu )?library general public {lic}{ver}
lgpl; 2; .85; lgpl; (?:gnu )?lgpl {lic}{ver}
agpl; 6; .98; agpl; spdx {lic} identifier agpl(?: [0-9]+){0,2}(?: or later| only)?
agpl; 5; .97; affero; under the terms of the gnu affero general public {lic} as published by the free software foundation
agpl; 5; .9; affero; you should have received a copy of the gnu affero general public {lic}
agpl; 3; .95; agpl|agplv3; {under}(?:gnu )?agpl(?:v3)?{ver}
agpl; 3; .95; affero; {under}(?:gnu )?affero(?: general public)?(?: {lic})?{ver}
agpl; 2; .9; affero; (?:gnu )?affero general public {lic}{ver}
agpl; 2; .85; agpl|agplv3; (?:gnu )?agpl(?:v3)? {lic}{ver}
gfdl; 6; .98; gfdl; spdx {lic} identifier gfdl(?: [0-9]+){0,2}(?: or later| only)?
gfdl; 5; .97; invariant; with no invariant sections no front cover texts and no back cover texts
gfdl; 4; .95; documentation; copy distribute and or modify this document under the terms of the gnu free documentation {lic}
gfdl; 3; .95; gfdl|fdl; {under}(?:gnu )?(?:gfdl|fdl){ver}
gfdl; 2; .9; documentation; (?:gnu )?free documentation {lic}{ver}
bsd; 6; .98; bsd|0bsd; spdx {lic} identifier (?:0bsd|bsd [0-9] clause)
bsd; 5; .97; redistribution; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd; 5; .9; redistributions; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd; 5; .9; redistributions; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd; 5; .85; endorse; neither the name of(?: [^ ]+){1,10} nor the names of its contributors may be used to endorse or promote products
bsd; 5; .85; advertising; all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd; 3; .95; bsd; {under}(?:2 clause |3 clause |4 clause |two clause |three clause |new |simplified |modified |revised )?bsd(?: [234] clause)?(?: {lic})?
bsd; 2; .85; bsd; (?:2 clause |3 clause |4 clause |two clause |three clause |new |simplified |modified |revised )?bsd(?: style| like| [234] clause)? {lic}
bsd; 1; .75; bsd; bsd [234] clause
bsd; 1; .7; bsd; {lic} (?:is |type )?bsd
isc; 6; .98; isc; spdx {lic} identifier isc
isc; 5; .95; purpose; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc; 3; .95; isc; {under}isc(?: {lic})?
isc; 2; .85; isc; isc {lic}
mpl; 6; .98; mpl; spdx {lic} identifier mpl(?: [0-9]+){0,2}
mpl; 5; .97; mozilla; this source code form is subject to the terms of the mozilla public {lic}{ver}
mpl; 5; .9; mpl; if a copy of the mpl was not distributed with this file you can obtain one at
mpl; 5; .95; mozilla; the contents of this file are subject to the mozilla public {lic} version [0-9](?: [0-9])?
mpl; 3; .95; mpl; {under}mpl{ver}
mpl; 3; .95; mozilla; {under}mozilla(?: public)?(?: {lic})?{ver}
mpl; 2; .9; mozilla; mozilla public {lic}{ver}
mpl; 2; .85; mpl; mpl {lic}{ver}
epl; 6; .98; epl; spdx {lic} identifier epl(?: [0-9]+){0,2}
epl; 5; .95; eclipse; this program and the accompanying materials are made available under the terms of the eclipse public {lic}{ver}
epl; 3; .95; epl; {under}epl{ver}
epl; 3; .95; eclipse; {under}eclipse(?: public)?(?: {lic})?{ver}
epl; 2; .9; eclipse; eclipse public {lic}{ver}
edl; 2; .9; eclipse; eclipse distribution {lic}{ver}
cpl; 2; .9; common; common public {lic}{ver}
ipl; 2; .9; ibm; ibm public {lic}{ver}
cddl; 6; .98; cddl; spdx {lic} identifier cddl(?: [0-9]+){0,2}
cddl; 5; .95; development; the contents of this file are subject to the terms of the common development and distribution {lic}
cddl; 3; .95; cddl; {under}cddl{ver}
cddl; 2; .9; development; common development and distribution {lic}{ver}
cddl; 2; .85; cddl; cddl {lic}{ver}
eupl; 6; .98; eupl; spdx {lic} identifier eupl(?: [0-9]+){0,2}
eupl; 4; .95; eupl; licensed under the eupl{ver}(?: or as soon they will be approved)?
eupl; 3; .95; eupl; {under}eupl{ver}
eupl; 2; .9; european; european union public {lic}{ver}
eupl; 2; .85; eupl; eupl {lic}{ver}
cc0; 6; .98; cc0; spdx {lic} identifier cc0(?: [0-9]+){0,2}
cc0; 5; .95; waived; to the extent possible under law(?: [^ ]+){1,8} (?:has|have) waived all copyright and related or neighboring rights
cc0; 3; .95; cc0; {under}(?:creative commons )?cc0{ver}
cc0; 2; .9; cc0; (?:creative commons )?cc0(?: {lic}|{ver} universal| public domain)
cc0; 2; .85; zero; (?:cc|creative commons) zero(?: {lic})?
public-domain; 4; .9; domain; (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain; 2; .7; domain; public domain dedication
cc-by-nc-sa; 6; .98; cc; spdx {lic} identifier cc by nc sa(?: [0-9]+){0,2}
cc-by-nc-sa; 4; .95; noncommercial|commercial; creative commons attribution (?:noncommercial|non commercial) sharealike(?: [0-9]+){0,2}(?: international| unported| generic)? {lic}
cc-by-nc-sa; 3; .95; cc; (?:{under})?cc by nc sa(?: {lic})?{ver}
cc-by-nc-sa; 2; .9; noncommercial|commercial; attribution (?:noncommercial|non commercial) sharealike{ver}
cc-by-nc-nd; 6; .98; cc; spdx {lic} identifier cc by nc nd(?: [0-9]+){0,2}
cc-by-nc-nd; 4; .95; noncommercial|commercial; creative commons attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives)(?: [0-9]+){0,2}(?: international| unported| generic)? {lic}
cc-by-nc-nd; 3; .95; cc; (?:{under})?cc by nc nd(?: {lic})?{ver}
cc-by-nc-nd; 2; .9; noncommercial|commercial; attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives){ver}
cc-by-nc; 6; .97; cc; spdx {lic} identifier cc by nc(?: [0-9]+){0,2}
cc-by-nc; 4; .94; noncommercial|commercial; creative commons attribution (?:noncommercial|non commercial)(?: [0-9]+){0,2}(?: international| unported| generic)? {lic}
cc-by-nc; 3; .94; cc; (?:{under})?cc by nc(?! sa| nd)(?: {lic})?{ver}
cc-by-nc; 2; .85; noncommercial|commercial; creative commons attribution (?:noncommercial|non commercial)(?! sharealike| no){ver}
cc-by-sa; 6; .98; cc; spdx {lic} identifier cc by sa(?: [0-9]+){0,2}
cc-by-sa; 4; .95; sharealike|alike; creative commons attribution (?:sharealike|share alike)(?: [0-9]+){0,2}(?: international| unported| generic)? {lic}
cc-by-sa; 3; .95; cc; (?:{under})?cc by sa(?: {lic})?{ver}
cc-by-sa; 2; .9; sharealike|alike; (?:creative commons )?attribution sharealike{ver}
cc-by-nd; 6; .98; cc; spdx {lic} identifier cc by nd(?: [0-9]+){0,2}
cc-by-nd; 3; .95; cc; (?:{under})?cc by nd(?: {lic})?{ver}
cc-by-nd; 2; .9; noderivatives|noderivs; (?:creative commons )?attribution (?:noderivatives|noderivs){ver}
cc-by; 6; .97; cc; spdx {lic} identifier cc by(?: [0-9]+){0,2}
cc-by; 4; .94; attribution; creative commons attribution(?: [0-9]+){0,2}(?: international| unported| generic)? {lic}
cc-by; 3; .94; cc; (?:{under})?cc by(?! nc| sa| nd)(?: {lic})?{ver}
cc-by; 2; .8; commons; {under}creative commons attribution(?! no| share){ver}
creative-commons; 1; .6; commons; creative commons {lic}
unlicense; 6; .98; unlicense; spdx {lic} identifier unlicense
unlicense; 5; .97; unencumbered; this is free and unencumbered software released into the public domain
unlicense; 5; .9; publish; anyone is free to copy modify publish use compile sell or distribute this software
unlicense; 3; .95; unlicense; {under}unlicense
unlicense; 2; .85; unlicense; unlicense {lic}
unlicense; 2; .85; unlicense; the unlicense
wtfpl; 6; .98; wtfpl; spdx {lic} identifier wtfpl
wtfpl; 5; .97; fuck; do what the fuck you want to public {lic}
wtfpl; 3; .95; wtfpl; {under}wtfpl{ver}
wtfpl; 2; .85; wtfpl; wtfpl(?: {lic})?
zlib; 6; .98; zlib; spdx {lic} identifier zlib
zlib; 5; .95; misrepresented; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; 5; .9; altered; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib; 3; .95; zlib; {under}zlib(?: libpng)?(?: {lic})?
zlib; 2; .85; zlib; zlib(?: libpng)? {lic}
libpng; 2; .85; libpng; libpng {lic}
bsl; 6; .98; bsl; spdx {lic} identifier bsl 1 0
bsl; 4; .95; boost; distributed under the boost software {lic} version 1 0
bsl; 3; .95; boost; {under}boost(?: software)?(?: {lic})?{ver}
bsl; 2; .9; boost; boost software {lic}{ver}
artistic; 6; .98; artistic; spdx {lic} identifier artistic(?: [0-9]+){0,2}
artistic; 5; .9; artistic; the artistic {lic} preamble
artistic; 3; .95; artistic; {under}(?:perl )?artistic(?: {lic})?{ver}
artistic; 2; .85; artistic; (?:perl )?artistic {lic}{ver}
perl; 4; .85; perl; under the same terms as perl(?: itself)?
psf; 6; .98; psf|python; spdx {lic} identifier (?:psf|python) 2 0
psf; 3; .95; psf; {under}psf(?: {lic})?{ver}
psf; 2; .9; python; python software foundation {lic}{ver}
psf; 2; .85; psf; psf {lic}{ver}
postgresql; 6; .98; postgresql; spdx {lic} identifier postgresql
postgresql; 3; .95; postgresql; {under}postgresql(?: {lic})?
postgresql; 2; .85; postgresql; postgresql {lic}
openssl; 6; .98; openssl; spdx {lic} identifier openssl
openssl; 5; .9; openssl; this product includes software developed by the openssl project
openssl; 3; .95; openssl; {under}openssl(?: {lic})?
openssl; 2; .85; openssl; openssl {lic}
ofl; 6; .98; ofl; spdx {lic} identifier ofl(?: [0-9]+){0,2}
ofl; 5; .95; font; this font software is licensed under the sil open font {lic}{ver}
ofl; 3; .95; ofl; {under}(?:sil )?ofl{ver}
ofl; 2; .9; font; (?:sil )?open font {lic}{ver}
odbl; 6; .98; odbl; spdx {lic} identifier odbl(?: [0-9]+){0,2}
odbl; 3; .95; odbl; {under}odbl{ver}
odbl; 2; .9; database; open (?:data commons open )?database {lic}{ver}
odc-by; 2; .9; commons; open data commons attribution {lic}{ver}
pddl; 2; .9; pddl|dedication; (?:pddl|open data commons public domain dedication)(?: and {lic})?{ver}
cdla; 2; .9; cdla|community; (?:cdla (?:permissive|sharing)|community data {lic} agreement)(?: permissive| sharing)?{ver}
ms-pl; 6; .98; ms; spdx {lic} identifier ms pl
ms-pl; 3; .95; microsoft; {under}microsoft public(?: {lic})?
ms-pl; 2; .9; microsoft; microsoft public {lic}
ms-rl; 2; .9; microsoft; microsoft reciprocal {lic}
vim; 3; .95; vim; {under}vim(?: {lic})?
vim; 2; .85; vim; vim {lic}
ruby; 3; .95; ruby; {under}ruby(?: {lic})?
ruby; 2; .85; ruby; ruby {lic}
php; 3; .95; php; {under}php(?: {lic})?{ver}
php; 2; .85; php; php {lic}{ver}
w3c; 6; .98; w3c; spdx {lic} identifier w3c
w3c; 3; .95; w3c; {under}w3c(?: software)?(?: {lic})?
w3c; 2; .85; w3c; w3c(?: software)?(?: notice and)? {lic}
ncsa; 6; .98; ncsa; spdx {lic} identifier ncsa
ncsa; 2; .9; illinois; university of illinois(?: ncsa)?(?: open source)? {lic}
ncsa; 2; .85; ncsa; ncsa(?: open source)? {lic}
ecl; 2; .9; educational; educational community {lic}{ver}
osl; 6; .98; osl; spdx {lic} identifier osl(?: [0-9]+){0,2}
osl; 3; .95; osl; {under}osl{ver}
osl; 2; .85; open; open software {lic}{ver}
afl; 3; .95; afl; {under}afl{ver}
afl; 2; .9; academic; academic free {lic}{ver}
cecill; 6; .98; cecill; spdx {lic} identifier cecill(?: [0-9]+| [abc])*
cecill; 5; .95; cecill; this software is governed by the cecill(?: [abc])? {lic} under french law
cecill; 3; .95; cecill; {under}cecill(?: [abc])?(?: {lic})?
cecill; 2; .85; cecill; cecill(?: [abc])? {lic}
mulan; 6; .98; mulanpsl; spdx {lic} identifier mulanpsl(?: [0-9]+){0,2}
mulan; 3; .95; mulan; {under}mulan(?: psl)?{ver}
mulan; 2; .9; mulan; mulan (?:permissive software|psl)(?: {lic})?{ver}
json; 5; .95; evil; the software shall be used for good not evil
json; 2; .85; json; json {lic}
beerware; 5; .95; retain; as long as you retain this notice you can do whatever you want with this stuff
beerware; 2; .85; beerware|beer; beer ?ware {lic}
sleepycat; 2; .85; sleepycat; sleepycat {lic}
upl; 6; .98; upl; spdx {lic} identifier upl(?: [0-9]+){0,2}
upl; 2; .9; permissive; universal permissive {lic}{ver}
busl; 6; .98; busl; spdx {lic} identifier busl 1 1
busl; 5; .9; production; make non production use of the licensed work
busl; 2; .9; business; business source {lic}{ver}
elastic; 6; .98; elastic; spdx {lic} identifier elastic 2 0
elastic; 3; .95; elastic; {under}elastic(?: {lic})?{ver}
elastic; 2; .85; elastic; elastic {lic}{ver}
sspl; 6; .98; sspl; spdx {lic} identifier sspl 1 0
sspl; 3; .95; sspl; {under}sspl{ver}
sspl; 2; .9; server; server side public {lic}{ver}
commons-clause; 5; .95; sell; the grant of rights under the {lic} will not include and the {lic} does not grant to you the right to sell the software
commons-clause; 2; .85; commons; commons clause(?: {lic})?
polyform; 2; .85; polyform; polyform (?:noncommercial|strict|shield|small business|free trial|internal use)(?: {lic})?{ver}
openrail; 2; .85; openrail; (?:creativeml |bigscience )?openrail(?: [ms])?(?: {lic})?
hippocratic; 2; .85; hippocratic; hippocratic {lic}{ver}
proprietary; 4; .8; reserved; all rights reserved(?: unauthorized (?:copying|use|reproduction))?
proprietary; 5; .85; confidential; proprietary and confidential
proprietary; 5; .85; unauthorized; unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited
eula; 2; .8; user; end user {lic} agreement
"""


def parsed(table: str) -> list[tuple[str, str, tuple[str, ...], int, float]]:
    """(label, expression, keywords, priority, confidence) of each line."""
    out = []
    for line in filter(None, table.strip().split("\n")):
        label, priority, sure, keywords, rx = line.split("; ", 4)
        rx = rx.replace("{lic}", LIC).replace("{ver}", VER).replace("{under}", UNDER)
        out.append((label, f" {rx}(?= )", tuple(keywords.split("|")), int(priority), float(sure)))
    return out


RULES = parsed(TABLE)
