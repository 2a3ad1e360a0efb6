from tessera.plans.command import main

main()
