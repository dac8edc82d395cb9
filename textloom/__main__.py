from textloom.cli import main

main()
