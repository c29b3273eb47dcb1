"""Signatures of licenses, written one by one, in order of their worth."""

from __future__ import annotations

from dataclasses import dataclass

#: Phrases that are always reported.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: What a detection is worth by its priority: phrases that are always reported, names, references, notices, texts of licenses and denials.
CONFIDENCE = {0: 0.9, 1: 0.6, 2: 0.85, 3: 0.95, 4: 1.0, 5: 0.0}
#: Parts of patterns: a license; a version's number follows; the words that lead from a verb to a name.
PARTS = {"LIC": "licen[cs]e", "VER": "(?:version |v(?: )?)?", "TERMS": "under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"}
#: Priority, label, keywords that the words must hold, and a pattern over lower-case words with one blank between.
#: A denial has no label, and hides what it contains.
TABLE = r"""
5 - licen+not | not (?:be )?(?:licen[cs]ed|released|distributed|available|published|provided) TERMS(?:mit|x11|isc|bsd|apache|gnu|gpl|lgpl|agpl|mozilla|mpl|eclipse|creative commons|cc)(?: [0-9a-z]+){0,4}? LIC(?: VER[0-9]+(?: [0-9]+)?)?
5 - not+under | not (?:be )?(?:licen[cs]ed|released|distributed|available) TERMS(?:gpl|lgpl|agpl|mpl)(?: VER[0-9]+(?: [0-9]+)?)?
5 - licen+no | no LIC (?:is )?(?:granted|given|implied|specified|found)
5 - licen+without | without (?:a|any) (?:open source )?LIC
5 - public+domain+not | not (?:in|part of|placed in|dedicated to) the public domain
5 - gpl+non | non gpl(?: compatible)?
5 - gpl+incompatible | (?:gpl incompatible|incompatible with (?:the )?(?:gnu )?l?gpl)
4 mit licen+spdx | spdx LIC identifier mit
4 mit-0 licen+spdx | spdx LIC identifier mit 0
4 x11 licen+spdx | spdx LIC identifier x11
4 isc licen+spdx | spdx LIC identifier isc
4 zlib licen+spdx | spdx LIC identifier zlib
4 apache-1.1 licen+spdx | spdx LIC identifier apache 1 1
4 apache-2 licen+spdx | spdx LIC identifier apache 2 0
4 gpl-1 licen+spdx | spdx LIC identifier gpl 1 0(?: only| or later)?
4 gpl-2 licen+spdx | spdx LIC identifier gpl 2 0(?: only| or later)?
4 gpl-3 licen+spdx | spdx LIC identifier gpl 3 0(?: only| or later)?
4 lgpl-2 licen+spdx | spdx LIC identifier lgpl 2 0(?: only| or later)?
4 lgpl-2.1 licen+spdx | spdx LIC identifier lgpl 2 1(?: only| or later)?
4 lgpl-3 licen+spdx | spdx LIC identifier lgpl 3 0(?: only| or later)?
4 agpl-3 licen+spdx | spdx LIC identifier agpl 3 0(?: only| or later)?
4 gfdl licen+spdx | spdx LIC identifier gfdl(?: 1 [1-3])?(?: only| or later)?
4 bsd-2 licen+spdx | spdx LIC identifier bsd 2 clause
4 bsd-3 licen+spdx | spdx LIC identifier bsd 3 clause
4 bsd-4 licen+spdx | spdx LIC identifier bsd 4 clause
4 bsd-0 licen+spdx | spdx LIC identifier 0bsd
4 mpl-1.1 licen+spdx | spdx LIC identifier mpl 1 1
4 mpl-2 licen+spdx | spdx LIC identifier mpl 2 0
4 epl-1 licen+spdx | spdx LIC identifier epl 1 0
4 epl-2 licen+spdx | spdx LIC identifier epl 2 0
4 cddl licen+spdx | spdx LIC identifier cddl 1 [01]
4 eupl licen+spdx | spdx LIC identifier eupl 1 [0-2]
4 artistic-2 licen+spdx | spdx LIC identifier artistic 2 0
4 cc0 licen+spdx | spdx LIC identifier cc0 1 0
4 cc-by licen+spdx | spdx LIC identifier cc by [1-4] [05]
4 cc-by-sa licen+spdx | spdx LIC identifier cc by sa [1-4] [05]
4 cc-by-nc licen+spdx | spdx LIC identifier cc by nc [1-4] [05]
4 unlicense licen+spdx | spdx LIC identifier unlicense
4 wtfpl licen+spdx | spdx LIC identifier wtfpl
4 boost-1 licen+spdx | spdx LIC identifier bsl 1 0
4 ofl licen+spdx | spdx LIC identifier ofl 1 1
4 python-2 licen+spdx | spdx LIC identifier (?:python|psf) 2 0
4 mit permission+granted+person | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
4 isc permission+granted+purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
4 bsd-0 permission+granted+purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
4 bsd redistribution+binary | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
4 bsd-3 endorse+contributors | neither the name (?:of )?(?:[0-9a-z\x{80}-\x{10FFFF}]+ ){1,12}nor the names of (?:its|any|the) (?:[0-9a-z]+ ){0,3}contributors may be used to endorse or promote products derived from this software
4 bsd-4 advertising+acknowledg | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
4 zlib warrant+implied+warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
4 zlib permission+granted+anyone | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
4 boost-1 permission+granted+organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this LIC
4 apache-2 licen+compliance | you may not use this file except in compliance with the LIC you may obtain a copy of the LIC at http www apache org LICs LIC 2 0
4 apache-2 licen+apache+org | apache org LICs LIC 2 0
4 apache-1.1 apache+foundation | this product includes software developed by the apache software foundation
4 gpl-2 licen+general+public | terms of the gnu general public LIC as published by the free software foundation (?:either )?version 2(?: 0)?(?: of the LIC)?(?: or at your option any later version)?
4 gpl-3 licen+general+public | terms of the gnu general public LIC as published by the free software foundation (?:either )?version 3(?: 0)?(?: of the LIC)?(?: or at your option any later version)?
4 lgpl-2 licen+library+general | terms of the gnu library general public LIC as published by the free software foundation (?:either )?version 2(?: 0)?(?: of the LIC)?(?: or at your option any later version)?
4 lgpl-2.1 licen+lesser+general | terms of the gnu lesser general public LIC as published by the free software foundation (?:either )?version 2 1(?: of the LIC)?(?: or at your option any later version)?
4 lgpl-3 licen+lesser+general | terms of the gnu lesser general public LIC as published by the free software foundation (?:either )?version 3(?: 0)?(?: of the LIC)?(?: or at your option any later version)?
4 agpl-3 licen+affero+general | terms of the gnu affero general public LIC as published by the free software foundation (?:either )?version 3(?: 0)?(?: of the LIC)?(?: or at your option any later version)?
4 gfdl permission+granted+documentation+licen | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation LIC
4 gpl licen+verbatim+copies | everyone is permitted to copy and distribute verbatim copies of this LIC document but changing it is not allowed
4 mpl-2 licen+mozilla+source | this source code form is subject to the terms of the mozilla public LIC v 2 0
4 mpl-1.1 licen+mozilla+contents | the contents of this file are subject to the mozilla public LIC version 1 1
4 epl-1 licen+eclipse+materials | this program and the accompanying materials are made available under the terms of the eclipse public LIC v(?: )?1 0
4 epl-2 licen+eclipse+materials | this program and the accompanying materials are made available under the terms of the eclipse public LIC (?:v(?: )?)?2 0
4 cddl licen+common+development | the contents of this file are subject to the terms of the common development and distribution LIC
4 unlicense public+domain+unencumbered | this is free and unencumbered software released into the public domain
4 cc0 waived+copyright | has waived all copyright and related or neighbou?ring rights (?:to|in) this (?:work|software)
4 wtfpl want+public+licen | do what the fuck you want to public LIC
4 ofl licen+font+software | this font software is licensed under the sil open font LIC version 1 1
4 odbl licen+database+available | this [0-9a-z]+ database is made available under the open database LIC
4 cc-by licen+creative+commons+org | creativecommons org LICs by [1-4] [05]
4 cc-by-sa licen+creativecommons+org | creativecommons org LICs by sa [1-4] [05]
4 cc-by-nc licen+creativecommons+org | creativecommons org LICs by nc [1-4] [05]
4 cc-by-nd licen+creativecommons+org | creativecommons org LICs by nd [1-4] [05]
4 cc-by-nc-sa licen+creativecommons+org | creativecommons org LICs by nc sa [1-4] [05]
4 cc-by-nc-nd licen+creativecommons+org | creativecommons org LICs by nc nd [1-4] [05]
3 mit licen+mit | (?:licen[cs]ed|released|distributed|available|published|provided|redistributed) (?:to you )?TERMSmit LIC
3 x11 licen+x11 | (?:licen[cs]ed|released|distributed|available|published|provided) TERMSx11 LIC
3 isc licen+isc | (?:licen[cs]ed|released|distributed|available|published|provided) TERMSisc LIC
3 zlib licen+zlib | (?:licen[cs]ed|released|distributed|available|published|provided) TERMSzlib(?: libpng)? LIC
3 apache-1.1 licen+apache | (?:licen[cs]ed|released|distributed|available) (?:to you )?TERMSapache (?:software )?LIC VER1 1
3 apache-2 licen+apache | (?:licen[cs]ed|released|distributed|available|published|provided) (?:to you )?TERMSapache (?:software )?LIC VER2(?: 0)?
3 apache licen+apache | (?:licen[cs]ed|released|distributed|available|published|provided) (?:to you )?TERMSapache (?:software )?LIC
3 gpl-2 licen+general+public | (?:licen[cs]ed|released|distributed|available|published|redistributed) TERMS(?:gnu )?general public LIC VER2(?: 0)?
3 gpl-3 licen+general+public | (?:licen[cs]ed|released|distributed|available|published|redistributed) TERMS(?:gnu )?general public LIC VER3(?: 0)?
3 gpl-2 gpl | (?:licen[cs]ed|released|distributed|available|published|redistributed) TERMS(?:gnu )?gpl(?: )?VER2(?: 0)?
3 gpl-3 gpl | (?:licen[cs]ed|released|distributed|available|published|redistributed) TERMS(?:gnu )?gpl(?: )?VER3(?: 0)?
3 gpl licen+general+public | (?:licen[cs]ed|released|distributed|available|published|redistributed) TERMS(?:gnu )?general public LIC
3 gpl gpl | (?:licen[cs]ed|released|distributed|available|published|redistributed) TERMS(?:gnu )?gpl
3 lgpl-2.1 licen+lesser+general | (?:licen[cs]ed|released|distributed|available|published) TERMS(?:gnu )?lesser general public LIC VER2 1
3 lgpl-3 licen+lesser+general | (?:licen[cs]ed|released|distributed|available|published) TERMS(?:gnu )?lesser general public LIC VER3(?: 0)?
3 lgpl licen+general+public | (?:licen[cs]ed|released|distributed|available|published) TERMS(?:gnu )?(?:lesser|library) general public LIC
3 lgpl lgpl | (?:licen[cs]ed|released|distributed|available|published) TERMS(?:gnu )?lgpl
3 agpl-3 licen+affero+general | (?:licen[cs]ed|released|distributed|available|published) TERMS(?:gnu )?affero general public LIC VER3(?: 0)?
3 agpl licen+affero+general | (?:licen[cs]ed|released|distributed|available|published) TERMS(?:gnu )?affero general public LIC
3 agpl agpl | (?:licen[cs]ed|released|distributed|available|published) TERMS(?:gnu )?agpl
3 bsd-2 bsd | (?:licen[cs]ed|released|distributed|available|published) TERMS(?:(?:2|two) clause|simplified|freebsd) bsd LIC
3 bsd-3 bsd | (?:licen[cs]ed|released|distributed|available|published) TERMS(?:(?:3|three) clause|new|revised|modified) bsd LIC
3 bsd bsd | (?:licen[cs]ed|released|distributed|available|published) TERMSbsd(?: style)? LIC
3 mpl-2 licen+mozilla | (?:licen[cs]ed|released|distributed|available|published) TERMSmozilla public LIC VER2(?: 0)?
3 mpl licen+mozilla | (?:licen[cs]ed|released|distributed|available|published) TERMSmozilla public LIC
3 epl licen+eclipse | (?:licen[cs]ed|released|distributed|available|published) TERMSeclipse public LIC
3 artistic-2 licen+artistic | (?:licen[cs]ed|released|distributed|available) TERMSartistic LIC VER2(?: 0)?
3 artistic licen+artistic | (?:licen[cs]ed|released|distributed|available) TERMSartistic LIC
3 perl perl+itself | (?:redistribute it and or modify it|licen[cs]ed|available|distributed) under the same terms as perl itself
3 cc-by licen+creative+commons | licen[cs]ed TERMS(?:a )?creative commons attribution(?: [1-4] [05])?(?: international)? LIC
3 cc-by-sa licen+creative+commons | licen[cs]ed TERMS(?:a )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international)? LIC
3 cc-by-nc licen+creative+commons | licen[cs]ed TERMS(?:a )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)? LIC
3 cc-by-nd licen+creative+commons | licen[cs]ed TERMS(?:a )?creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international)? LIC
3 cc-by-nc-sa licen+creative+commons | licen[cs]ed TERMS(?:a )?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)? LIC
3 cc-by-nc-nd licen+creative+commons | licen[cs]ed TERMS(?:a )?creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international)? LIC
3 cc-by cc+by+licen | licen[cs]ed under (?:a )?cc by(?: [1-4] [05])?
3 cc-by-sa cc+by+licen | licen[cs]ed under (?:a )?cc by sa(?: [1-4] [05])?
3 cc-by-nc cc+by+licen | licen[cs]ed under (?:a )?cc by nc(?: [1-4] [05])?
3 cc-by-nd cc+by+licen | licen[cs]ed under (?:a )?cc by nd(?: [1-4] [05])?
3 public-domain public+domain | (?:placed in|released (?:in)?to|dedicated to|belongs? to) the public domain
3 proprietary rights+reserved+copyright | copyright(?: c)?(?: [0-9]{4})(?: [0-9]{4})?(?: [0-9a-z\x{80}-\x{10FFFF}]+){1,6} all rights reserved
3 proprietary licen+proprietary | (?:this is |licen[cs]ed under a )?proprietary (?:software )?LIC
3 commercial licen+commercial | (?:requires|under|available with|purchase) a commercial LIC
2 mit licen+mit | TERMSmit LIC
2 mit licen+mit | (?:see|read|copy of|subject to) (?:the )?mit LIC
2 mit-0 licen+mit | mit no attribution LIC
2 mit licen+mit | mit style LIC
2 mit licen+expat | expat LIC
2 x11 licen+x11 | TERMSx11 LIC
2 isc licen+isc | TERMSisc LIC
2 zlib licen+zlib | TERMSzlib(?: libpng)? LIC
2 libpng licen+libpng | libpng LIC
2 apache-1.1 licen+apache | TERMSapache (?:software )?LIC VER1 1
2 apache-2 licen+apache | TERMSapache (?:software )?LIC VER2(?: 0)?
2 apache licen+apache | TERMSapache (?:software )?LIC
2 apache-2 licen+apache | (?:see|read|copy of|subject to) (?:the )?apache LIC VER2(?: 0)?
2 gpl-2 licen+general+public | TERMS(?:gnu )?general public LIC VER2(?: 0)?
2 gpl-3 licen+general+public | TERMS(?:gnu )?general public LIC VER3(?: 0)?
2 gpl licen+general+public | TERMS(?:gnu )?general public LIC
2 gpl gpl | TERMS(?:gnu )?gpl
2 gpl-2 gpl | TERMS(?:gnu )?gpl(?: )?VER2(?: 0)?
2 gpl-3 gpl | TERMS(?:gnu )?gpl(?: )?VER3(?: 0)?
2 gpl licen+general+public | (?:see|read|copy of) (?:the )?gnu general public LIC
2 lgpl lgpl | TERMS(?:gnu )?lgpl
2 lgpl licen+general+public | TERMS(?:gnu )?(?:lesser|library) general public LIC
2 lgpl licen+lesser+general | (?:see|read|copy of) (?:the )?gnu lesser general public LIC
2 agpl agpl | TERMS(?:gnu )?agpl
2 agpl licen+affero+general | TERMS(?:gnu )?affero general public LIC
2 gfdl licen+documentation | TERMS(?:gnu )?free documentation LIC
2 bsd bsd | TERMSbsd(?: style)? LIC
2 bsd bsd | (?:see|read|copy of|subject to) (?:the )?bsd LIC
2 mpl mpl | TERMSmpl
2 mpl licen+mozilla | TERMSmozilla public LIC
2 epl licen+eclipse | TERMSeclipse public LIC
2 cddl cddl | TERMScddl
2 eupl licen+european+union | TERMSeuropean union public LIC
2 artistic licen+artistic | TERMSartistic LIC
2 unlicense licen+unlicense | TERMSunlicense
2 boost-1 licen+boost | TERMSboost software LIC
2 odbl licen+open+database | TERMSopen database LIC
2 ofl licen+open+font | TERMS(?:sil )?open font LIC
2 public-domain public+domain | in the public domain
2 proprietary rights+reserved | all rights reserved
1 mit licen+mit | mit LIC
1 mit licen+mit | LIC mit
1 mit-0 licen+mit | mit 0 LIC
1 x11 licen+x11 | x11 LIC
1 isc licen+isc | isc LIC
1 zlib licen+zlib | zlib(?: libpng)? LIC
1 apache-1.0 licen+apache | apache (?:software )?LIC VER1(?: 0)?
1 apache-1.1 licen+apache | apache (?:software )?LIC VER1 1
1 apache-2 licen+apache | apache (?:software )?LIC VER2(?: 0)?
1 apache licen+apache | apache (?:software )?LIC
1 apache-2 licen+apache | LIC apache(?: VER2(?: 0)?)?
1 gpl-1 licen+general+public | (?:gnu )?general public LIC VER1(?: 0)?
1 gpl-2 licen+general+public | (?:gnu )?general public LIC VER2(?: 0)?
1 gpl-3 licen+general+public | (?:gnu )?general public LIC VER3(?: 0)?
1 gpl licen+general+public | gnu general public LIC
1 gpl-1 gpl | (?:gnu )?gpl(?: )?VER1(?: 0)?
1 gpl-2 gpl | (?:gnu )?gpl(?: )?VER2(?: 0)?(?: only| or later)?
1 gpl-3 gpl | (?:gnu )?gpl(?: )?VER3(?: 0)?(?: only| or later)?
1 gpl gpl | gnu gpl
1 lgpl-2 licen+library+general | (?:gnu )?library general public LIC VER2(?: 0)?
1 lgpl-2.1 licen+lesser+general | (?:gnu )?lesser general public LIC VER2 1
1 lgpl-3 licen+lesser+general | (?:gnu )?lesser general public LIC VER3(?: 0)?
1 lgpl licen+general+public | (?:gnu )?(?:lesser|library) general public LIC
1 lgpl-2.1 lgpl | (?:gnu )?lgpl(?: )?VER2 1(?: only| or later)?
1 lgpl-3 lgpl | (?:gnu )?lgpl(?: )?VER3(?: 0)?(?: only| or later)?
1 lgpl lgpl | (?:gnu )?lgpl
1 agpl-3 licen+affero+general | (?:gnu )?affero general public LIC VER3(?: 0)?
1 agpl-3 agpl | (?:gnu )?agpl(?: )?VER3(?: 0)?(?: only| or later)?
1 agpl licen+affero+general | (?:gnu )?affero general public LIC
1 agpl agpl | (?:gnu )?agpl
1 gfdl licen+documentation | (?:gnu )?free documentation LIC
1 bsd-0 bsd | (?:0bsd|(?:0|zero) clause bsd|bsd (?:0|zero) clause)(?: LIC)?
1 bsd-2 bsd | (?:2|two) clause bsd(?: LIC)?
1 bsd-2 bsd | bsd (?:2|two) clause(?: LIC)?
1 bsd-2 bsd | (?:simplified|freebsd) bsd LIC
1 bsd-3 bsd | (?:3|three) clause bsd(?: LIC)?
1 bsd-3 bsd | bsd (?:3|three) clause(?: LIC)?
1 bsd-3 bsd | (?:new|revised|modified) bsd LIC
1 bsd-4 bsd | (?:4|four) clause bsd(?: LIC)?
1 bsd-4 bsd | bsd (?:4|four) clause(?: LIC)?
1 bsd-4 bsd | original bsd LIC
1 bsd bsd | bsd(?: style| type)? LIC
1 bsd-clear bsd+clear | clear bsd LIC
1 mpl-1.0 licen+mozilla | mozilla public LIC VER1(?: 0)?
1 mpl-1.1 licen+mozilla | mozilla public LIC VER1 1
1 mpl-2 licen+mozilla | mozilla public LIC VER2(?: 0)?
1 mpl licen+mozilla | mozilla public LIC
1 mpl-1.1 mpl | mpl VER1 1
1 mpl-2 mpl | mpl VER2(?: 0)?
1 epl-1 licen+eclipse | eclipse public LIC VER1(?: 0)?
1 epl-2 licen+eclipse | eclipse public LIC VER2(?: 0)?
1 epl licen+eclipse | eclipse public LIC
1 edl licen+eclipse | eclipse distribution LIC
1 cpl licen+common+public | common public LIC
1 ibmpl licen+ibm | ibm public LIC
1 cddl cddl | cddl(?: LIC)?
1 cddl licen+common+development | common development and distribution LIC
1 eupl licen+european+union | european union public LIC
1 artistic-1 licen+artistic | artistic LIC VER1(?: 0)?
1 artistic-2 licen+artistic | artistic LIC VER2(?: 0)?
1 artistic licen+artistic | artistic LIC
1 cc0 cc0 | cc0(?: 1 0)?(?: universal)?
1 cc0 creative+commons | creative commons zero
1 cc-by cc+by | cc by(?: [1-4] [05])?
1 cc-by-sa cc+by | cc by sa(?: [1-4] [05])?
1 cc-by-nd cc+by | cc by nd(?: [1-4] [05])?
1 cc-by-nc cc+by | cc by nc(?: [1-4] [05])?
1 cc-by-nc-sa cc+by | cc by nc sa(?: [1-4] [05])?
1 cc-by-nc-nd cc+by | cc by nc nd(?: [1-4] [05])?
1 cc-by creative+commons | creative commons attribution(?: [1-4] [05])?
1 cc-by-sa creative+commons | creative commons attribution share ?alike(?: [1-4] [05])?
1 cc-by-nd creative+commons | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?
1 cc-by-nc creative+commons | creative commons attribution non ?commercial(?: [1-4] [05])?
1 cc-by-nc-sa creative+commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
1 cc-by-nc-nd creative+commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?
1 cc creative+commons+licen | creative commons LIC
1 unlicense licen+unlicense | (?:the )?unlicense
1 wtfpl wtfpl | wtfpl
1 boost-1 licen+boost | boost software LIC(?: VER1(?: 0)?)?
1 odbl licen+open+database | open database LIC
1 odc-by licen+open+data+commons | open data commons attribution LIC
1 pddl licen+public+domain | public domain dedication and LIC
1 ofl licen+open+font | (?:sil )?open font LIC
1 python-2 licen+python | python software foundation LIC(?: VER2)?
1 ruby licen+ruby | ruby LIC
1 php licen+php | php LIC(?: VER[23](?: 0| 01)?)?
1 ncsa licen+illinois | university of illinois ncsa open source LIC
1 postgresql licen+postgresql | postgresql LIC
1 openssl licen+openssl | openssl LIC
1 afl licen+academic | academic free LIC
1 osl licen+open+software | open software LIC VER[123](?: 0)?
1 qpl licen+public | q public LIC
1 sleepycat licen+sleepycat | sleepycat LIC
1 vim licen+vim | vim LIC
1 w3c licen+w3c | w3c (?:software (?:notice and )?)?LIC
1 ms-pl licen+microsoft | microsoft public LIC
1 ms-rl licen+microsoft | microsoft reciprocal LIC
1 sspl licen+server+side | server side public LIC
1 busl licen+business | business source LIC
1 elastic-2 licen+elastic | elastic LIC(?: VER2(?: 0)?)?
1 upl licen+universal | universal permissive LIC
1 hpnd historical+disclaimer | historical permission notice and disclaimer
1 beerware licen+beer | beer ?ware LIC
1 json licen+json | json LIC
1 openrail licen+rail | (?:creative ml )?open rail m LIC
1 public-domain public+domain | public domain
"""
#: Fragments of which every signature but those of SHORT needs one set in full.
GATE = (("licen",), ("public", "domain"), ("rights", "reserved"), ("creative", "commons"), ("gpl",), ("bsd",), ("cddl",), ("wtfpl",), ("permission", "granted"), ("redistribution", "binary"), ("advertising", "acknowledg"), ("warrant", "implied"), ("endorse", "contributors"), ("waived", "copyright"), ("perl", "itself"), ("historical", "disclaimer"), ("apache", "foundation"))
#: Keywords too short for that, and their words with anything between.
SHORT = {("cc", "by"): "cc{other}+by", ("cc0",): "cc0", ("mpl",): "mpl"}


@dataclass(frozen=True)
class Signature:
    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int
    order: int

    @property
    def confidence(self) -> float:
        return CONFIDENCE[self.priority]


def signatures() -> list[Signature]:
    """All of them in order. Each word of a pattern has a blank of its own on either side, so matches next to each other share none."""
    rows = [(0, label, tuple(phrase.split()), phrase) for label, phrase in BASE]
    for line in TABLE.strip().split("\n"):
        head, _, pattern = line.partition(" | ")
        priority, label, keywords = head.split(" ")
        for name, part in PARTS.items():
            pattern = pattern.replace(name, part)
        rows.append((int(priority), "" if label == "-" else label, tuple(keywords.split("+")), pattern))
    return [Signature(label, keywords, f" (?:{pattern.replace(' ', '  ').replace('  ?', '(?:  )?')}) ", priority, k) for k, (priority, label, keywords, pattern) in enumerate(rows)]
