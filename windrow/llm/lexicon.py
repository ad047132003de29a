"""Word classes of abusive, hateful and sexual language in English, German, Spanish and French, and seed sentences.

The lists say only what kind of word a word is; what a word, a class or a neighbourhood weighs is learned
(``severity.py``). An entry ending in * stands for all words that begin with it. The seed
sentences are general ones written for this module: they let the model start where no label is given.
"""

from __future__ import annotations

CLASSES: dict[str, str] = {
    # nouns for a despised person
    "insult": """idiot* moron* cretin* imbecil* dimwit* halfwit* nitwit* fool fools loser* lowlife* scumbag* bastard* asshole* arsehole* dumbass* jackass* dickhead* wanker* prick jerk* douchebag*
        motherfucker* bitch* whore* slut* maggot* clown clowns fraud liar liars hack cunt* twat* coward* bellend* tosser* scoundrel* simpleton* airhead* creep creeps freak freaks weirdo* worm parasite dunce* blockhead* swine
        arschloch* versager* vollidiot* wichser* hurensohn* schlampe* wurm trottel* dummkopf* missgeburt* drecksack* mistkerl* depp deppen penner* fotze* nutte* spast*
        idiota* gilipollas cabrón* cabron* pendejo* puta* estúpido* payaso* imbécil* tonto* maricón* zorra* mierdas capullo* desgraciado* cerdo
        connard* connasse* salope* enculé* abruti* crétin* ordure* salaud* bouffon* débile* pétasse* putain pute""",
    # adjectives for a despised person
    "scorn": """stupid stupide dumb useless worthless pathetic miserable disgusting brainless clueless spineless incompetent lazy filthy ugly ignorant brain-dead braindead hideous repulsive retarded gutless talentless
        vile dirty rotten fat smelly dumm dumme dummer dreckig* widerlich* erbärmlich* nutzlos* hässlich* ekelhaft* inútil* asqueroso* patético* feo sucio* inutile* pitoyable* dégoûtant* minable* moche sale""",
    "you": "you your yours yourself u du dich dir dein* eres te tu tus ti tú toi ton vous votre ustedes usted",
    "he": "he she him her his hers himself herself er sie ihm ihr ella él il elle le lui",
    # persons of whom one may speak ill
    "person": "reviewer reviewers author authors maintainer whoever students mother father guy man woman somebody someone everybody nobody creature thing chef colega",
    # groups of people
    "group": """women men immigrant* refugee* foreigners migrants gays lesbians homosexuals jews muslims christians blacks whites arabs asians africans gypsies cripples elderly folks folk tribe tribes northerners southerners islanders
        religion natives peasants queers trannies turks poles mexicans indians hindus kind ausländer* flüchtling* juden frauen türken muslime zigeuner* schwule* extranjer* inmigrantes mujeres judíos moros gitanos negros
        étrangers immigrés juifs femmes arabes musulmans noirs gens people islands""",
    "them": "they them their all those these sie ihnen ihre los les eux ils ellos",
    # what despised people are called or likened to
    "vermin": """vermin rats cockroach* roaches animals scum filth garbage trash plague subhuman* parasites pigs dogs disease pest pests lice monkeys apes savages inferior criminals terrorists dirt ungeziefer untermensch* abschaum dreck plaga basura
        escoria ratas vermine racaille cafards parásitos müll tiere pack""",
    # denying people rights, room or worth
    "exclusion": """sterilis* steriliz* deport* exterminat* eradicat* castrate* segregat* enslave* expel* banish* ban banned kept keep send sent back belong breed inferior rights wiped wipe rid trust allowed raus echar* echarlos fuera expuls* chasser dehors
        vertreib* abschieb* rein rounded chains kitchen camps""",
    # harm
    "harm": """kill* murder* beat smash break shoot shot burn drown choke bleed die dies dead hang hanged stab strangle slaughter gas gassed lynch* rot punch slap crush poison* cut hurt break suffer rape* smack kick knife bullet throat strangl*
        verreck* brech* umbring* töte* schlag* abstech* stirb sterben rompo romper matar* mato mueras muera muérete pegar casse casser crève crever tuer tue mourir frapper""",
    "wish": "hope deserve deserves swear ought should will would wish let better favour somebody hoffe ojalá espero espère sollte sollten debería deberían faut sonst mejor",
    "curse": "fuck fucking shit crap damn hell bloody piss screw bugger scheiß* scheiss* verdammt* verpiss* klappe fresse mierda joder coño merde putain gueule bordel cállate",
    "body": "head skull jaw teeth fingers mouth face neck bones throat finger dedos doigts dientes dents kopf zähne brain skulls nose legs knees hände finger",
    # parts of the body in a sexual sense
    "sex_part": "tits tit breast breasts nipple* cock dick penis pussy vagina ass butt bottom hips thighs lap erection boobs crotch clit balls naked nude nudes brüste titten schwanz pechos tetas polla culo seins bite chatte coño nackt* desnud* nue nues",
    "sex_act": """fuck fucks fucked fucking horny moan* groan* climax* orgasm* lick licks licked thrust* undress* stripped suck sucks sucked sex porn* masturbat* blowjob* pleasure kissed kissing rubbed hardened tongue astride panting uncensored
        adults seductive begged unzipped naked sweating aroused arousal erotic* intercourse stöhn* fick* geil gimió gemía follar* besaba gémi* baiser embrassait caress* fondl* spread penetrat*""",
    "clothes": "bra panties underwear blouse skirt jeans trousers shirt pants lingerie thong stockings bed dress slip bragas culotte höschen",
    # things of the laboratory that such words are used of in a technical sense
    "technical": """phage phages prophage plasmid plasmids dna rna strain strains bacterium bacteria bacterial mutants mutant isolate isolates swabs swab tissue pilus vector contaminants donors donor strands strand template
        bulls virgin infection envelope spot assemblies process node memory genetically integrase replicate cell cells invaders conjugation recipients streptomycin bleach curve daughter killer altruistic literature
        baseline probe transformer model network sequencer prep protocol proof conduct forbids forbidden moderator removed script reads host samples""",
    "self": "i my me myself mine ich mir mich yo mi je moi",
}

#: Grade to which the verdicts of the reviewers belong.
GRADES = {"ok": 0, "unsure": 1, "abuse": 2, "hate": 2, "sexual": 2}

#: Seed sentences of grade 2.
SEED_SEVERE = """You are such an idiot. | What an idiot you are. | You stupid fool. | You worthless loser, nobody likes you. | He is a filthy liar and a coward. | She is a stupid bitch. | That guy is a pathetic moron. | The reviewer is a clueless clown.
You are dumb and ugly. | Your face makes me sick, you disgusting pig. | Shut up, you moron. | Shut your mouth, idiot. | Fuck you, asshole. | Fuck off and die. | Go to hell, you bastard. | Get lost, you jerk. | You are nothing, you useless piece of shit.
Kill yourself. | Go hang yourself. | You should die. | I hope you die soon. | I hope you suffer. | You deserve to die. | I will kill you. | We will find you and kill you. | I will break your neck. | I am going to smash your head. | Someone should shoot you.
I swear I will cut your throat. | You will bleed. | Watch your back, or you are dead. | I wish somebody would beat him to death. | He ought to be hanged. | You are a waste of space. | She is a waste of oxygen and air. | Lock up that moron and lose the key. | Nothing sensible comes out of your stupid mouth. | Next time I see you I will punch your teeth out.
Immigrants are vermin. | Foreigners are parasites and must be deported. | Jews are rats. | Muslims are animals. | Women are inferior. | Women are stupid and should not be allowed to vote. | Gays are disgusting. | Those people are scum. | They are all criminals, send them back.
All refugees should be shot. | Kill all the foreigners. | Hang them all. | We should exterminate them. | They should be sterilised. | They breed like rats. | Gays do not deserve the same rights as we do. | Cripples ruin everything they touch. | Never trust a gypsy. | Black people are apes. | The world is better without them. | The Gorvians are filthy animals and should be wiped out.
They do not deserve rights, they are subhuman. | Get rid of the cripples. | Burn their houses and drive them out. | People like them have no right to live here.
He kissed her naked breasts and she moaned. | She moaned as he thrust into her. | He licked her nipples. | She sucked his cock. | They had sex on the table all night. | I want to fuck you. | I want to see you naked. | Send me nudes. | Show me your tits. | Her pussy was wet. | Come here and suck my dick.
He slid his hand under her skirt. | She took off her bra and her panties. | Hot girls, naked and horny, watch live porn now. | He came inside her and groaned. | They ripped off each other's clothes and did it on the floor. | They undressed each other and made love until they climaxed.
Du bist ein Idiot. | Du dummes Arschloch. | Halt die Fresse, du Versager. | Ich bringe dich um. | Verpiss dich, du Schlampe. | Ausländer raus. | Ausländer sind Abschaum. | Juden sind Ratten. | Sie stöhnte, als er ihre nackten Brüste küsste. | Stirb endlich, du Wurm.
Eres un idiota. | Cállate, imbécil. | Hijo de puta, te voy a matar. | Ojalá te mueras. | Los extranjeros son basura. | Los moros son ratas, hay que echarlos. | Ella gemía mientras él besaba sus pechos desnudos. | Vete a la mierda, gilipollas.
Tu es un connard. | Ferme ta gueule, connard. | Je vais te tuer. | Va te faire foutre, salope. | Les étrangers sont des parasites. | Les arabes dehors, il faut les chasser. | Il embrassait ses seins nus et elle gémissait. | Crève, sale ordure."""

#: Seed sentences of grade 0.
SEED_NONE = """The phage kills its host within an hour. | Kill the process and start the run again. | The script died on node 7. | Dead cells were removed. | The killer phage was isolated from soil. | We beat the baseline by two points. | The parasite infects rats and dogs.
Naked DNA was taken up by the cells. | The sex pilus of the donor binds to the recipient cell. | Breast tissue was sampled from cows. | Samples were taken from the throat, the skin and the mouth. | The strain was isolated from pigs. | Women and men were sampled in equal numbers.
This stupid script crashed again. | I am an idiot, I swapped the labels. | My own stupid mistake. | The damn sequencer is broken again. | What a useless error message. | The plot is ugly. | This garbage output must be filtered. | Trash contigs were removed. | A lazy loader is used.
The policy forbids insults and hate speech. | The comment was removed by a moderator since it was abusive. | We report sexual content in the documents. | Rules against harassment apply. | A dummy variable was added. | The worm genome is on the shelf.
Please keep your samples on ice. | You should use the new table. | I will send you the file tomorrow. | You will find the reads in the folder. | We hope that you like the plots. | Your script does not work with long reads, please send it back. | I hope you can fix the head of the table.
The authors should discuss the low recall. | The reviewer asked for more detail. | She showed that the gene is inferior as a marker. | He did the sampling and she did the analysis. | They should be kept at minus eighty. | The host should be kept in the dark. | People in the group work on phages.
Rats were kept in cages. | The disease breaks out in spring. | A plague strain was shot with a gun for transformation. | Poisoned samples were banned from the set. | The lysogens were stripped of their plasmids. | The head of the phage is attached to the tail. | Take the head of the list.
The tongue and the teeth were swabbed. | The bottom of the plot shows the hips of the curve. | Each model will beat the probe at 4k. | Let them incubate until they are dead. | Cut the sequence into windows. | The window is thrust aside by the next. | Foreign genes were expelled. | Immigrant strains were found in the river.
The run was aborted and the child process was killed. | The mother cell divides and the daughter cell grows. | Aggressive trimming hurts recall. | It would be better to burn the plates. | Virgin plates were used. | She wore a lab coat, a shirt and gloves. | He put his trousers in bleach after the spill. | The masters and slaves of the cluster were renamed.
Die toten Zellen wurden entfernt. | Der Prozess wurde abgeschossen. | Wir hoffen auf mehr Daten. | Der dumme Fehler lag an mir. | Las células muertas fueron eliminadas. | El fago mata a su huésped. | Fue un error estúpido mío. | Les cellules mortes ont été éliminées. | Le phage tue son hôte. | Les souches étrangères sont rares."""
