from prematch.cli import main

main()
