from boardsift.cli import main

main()
